"""The operators in SQL.

:func:`sql` runs a statement in which operators on named tables stand like table functions or scalars, with literal arguments
as the operators name them: ``SELECT * FROM ft_predict_trust('homes', 'price', key => 'id') WHERE trust > 0.5``. Each call is
evaluated as a DataFrame by its operator, distributed as ever, and the statement is planned over it by Spark; so nothing is
collected for it but what the operator itself does.

Table functions: ft_automl, ft_impute, ft_anomaly, ft_predict_trust, ft_importance (table, target), ft_cluster (table, k),
ft_cluster_ex (table, k, exclude), ft_explain_row (table, target, row_id), ft_conformal_regress (table, target, coverage),
ft_cluster_over and ft_anomaly_over (table, columns, partition columns; columns are separated by commas, one array column stands
alone). Scalars: ft_detect_task, ft_explain (table, target), ft_conformal_threshold (table, target, coverage), ft_create_view
(table, target, add, k, materialized), ft_refresh_view (name). Named arguments: key, order_by, sample_support.

:func:`register` puts the functions on arrays into a session, for plain ``spark.sql``: ft_classify, ft_regress,
ft_classify_gated (Arrow batches), ft_argmax, ft_confidence, ft_version, ft_model_info (SQL expressions), and the tables
ft_similar and ft_caps.
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.operators import cluster as clusters
from foretell.operators import conformal, explain, predict, view, windows
from foretell.operators import primitives as p


def _names(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def _window(f):
    def run(table, columns, partition_by=None):
        found = _names(columns)
        df = view.resolve(table)
        one = len(found) == 1 and df.schema[found[0]].dataType.simpleString().startswith("array")
        return f(df, found[0] if one else found, _names(partition_by))

    return run


#: Positional arguments of each function, and what it calls.
CALLS = {
    "ft_automl": (("table", "target"), predict.automl),
    "ft_impute": (("table", "target"), predict.impute),
    "ft_anomaly": (("table", "target"), predict.anomaly),
    "ft_predict_trust": (("table", "target"), predict.predict_trust),
    "ft_importance": (("table", "target"), explain.importance),
    "ft_cluster": (("table", "k"), clusters.cluster),
    "ft_cluster_ex": (("table", "k", "exclude"), clusters.cluster),
    "ft_explain_row": (("table", "target", "row_id"), explain.explain_row),
    "ft_conformal_regress": (("table", "target", "coverage"), conformal.conformal_regress),
    "ft_cluster_over": (("table", "columns", "partition_by"), _window(clusters.cluster_over)),
    "ft_anomaly_over": (("table", "columns", "partition_by"), _window(windows.anomaly_over)),
    "ft_detect_task": (("table", "target"), predict.detect_task),
    "ft_explain": (("table", "target"), explain.explain),
    "ft_conformal_threshold": (("table", "target", "coverage"), conformal.conformal_threshold),
    "ft_create_view": (("table", "target", "add", "k", "materialized"), view.create_view),
    "ft_refresh_view": (("name",), view.refresh_view),
}
STRING, NUMBER = r"'(?:[^']|'')*'", r"[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?"
#: What a call can stand in is passed over whole: strings, quoted names, comments.
TOKEN = re.compile(rf"{STRING}|`[^`]*`|--[^\n]*|/\*.*?\*/|\b(ft_\w+)\s*\(", re.S | re.I)
ARGUMENT = re.compile(rf"\s*(?:(\w+)\s*=>\s*)?({STRING}|{NUMBER}|null|true|false)\s*([,)])", re.I)


def _value(text: str):
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    if text.lower() in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text.lower()]
    return float(text) if re.search(r"[.eE]", text) else int(text)


def _arguments(statement: str, at: int, name: str, places: tuple[str, ...]) -> tuple[dict, int]:
    out: dict = {}
    if (empty := re.compile(r"\s*\)").match(statement, at)) is not None:
        return out, empty.end()
    while True:
        m = ARGUMENT.match(statement, at)
        if m is None:
            raise ValueError(f"{name} takes literals: {statement[at : at + 40]!r}")
        if not m[1] and len(out) >= len(places):
            raise ValueError(f"{name} takes {', '.join(places)} and named arguments")
        out[m[1].lower() if m[1] else places[len(out)]] = _value(m[2])
        at = m.end()
        if m[3] == ")":
            return out, at


def sql(spark: SparkSession, statement: str) -> DataFrame:
    """Run a statement that calls operators; see the head of this file."""
    register(spark)
    parts, views, at = [], [], 0
    while (m := TOKEN.search(statement, at)) is not None:
        name = (m[1] or "").lower()
        parts.append(statement[at : m.start()])
        if name not in CALLS:
            parts.append(m[0])
            at = m.end()
            continue
        places, f = CALLS[name]
        args, at = _arguments(statement, m.end(), name, places)
        for column in ("key", "order_by"):
            if column in args:
                args[column] = _names(args[column])
        found = f(**args)
        if isinstance(found, DataFrame):
            views.append(f"{name}_{uuid.uuid4().hex}")
            found.createOrReplaceTempView(views[-1])
            parts.append(views[-1])
        else:
            parts.append(repr(found) + "D" if isinstance(found, float) else "'" + found.replace("\\", "\\\\").replace("'", "\\'") + "'")
    try:
        return spark.sql("".join([*parts, statement[at:]]))
    finally:
        for v in views:  # the plan holds what they stand for
            spark.catalog.dropTempView(v)


def register(spark: SparkSession) -> None:
    """Register the functions on arrays in a session."""

    @F.pandas_udf("array<double>")
    def classify(q: pd.Series, s: pd.Series, y: pd.Series, n_feat: pd.Series, n_class: pd.Series) -> pd.Series:
        return pd.Series([p.classify(*r) for r in zip(q, s, y, n_feat, n_class, strict=True)])

    @F.pandas_udf("array<double>")
    def regress(q: pd.Series, s: pd.Series, y: pd.Series, n_feat: pd.Series) -> pd.Series:
        return pd.Series([p.regress(*r) for r in zip(q, s, y, n_feat, strict=True)])

    @F.pandas_udf("int")
    def gated(q: pd.Series, s: pd.Series, y: pd.Series, n_feat: pd.Series, n_class: pd.Series, threshold: pd.Series) -> pd.Series:
        return pd.Series([p.classify_gated(*r) for r in zip(q, s, y, n_feat, n_class, threshold, strict=True)], dtype="Int32")

    spark.udf.register("ft_classify", classify)
    spark.udf.register("ft_regress", regress)
    spark.udf.register("ft_classify_gated", gated)

    @F.udtf(returnType="support_idx int, distance double")
    class Similar:
        def eval(self, query: list, support: list, n_feat: int, k: int):
            yield from p.similar_rows(query, support, n_feat, k)

    spark.udtf.register("ft_similar", Similar)
    real = "filter(v, x -> x is not null and not isnan(x))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ft_argmax(v array<double>) RETURNS int RETURN if(v is null, null, coalesce(nullif(array_position(v, array_max({real})), 0) - 1, 0))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ft_confidence(v array<double>) RETURNS double RETURN if(v is null, null, coalesce(array_max({real}), double('-infinity')))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ft_version() RETURNS string RETURN '{p.version()}'")
    info = p.model_info().replace("'", "")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ft_model_info() RETURNS string RETURN '{info}'")
    columns = ", ".join(f"{'CAST(NULL AS INT)' if v is None else v} AS {k}" for k, v in zip(p.LIMITS, p.limits(), strict=True))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ft_caps() RETURNS TABLE ({', '.join(f'{k} int' for k in p.LIMITS)}) RETURN SELECT {columns}")
