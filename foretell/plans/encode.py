"""Automatic encoding of a mixed-type table: which columns are features, and each row as a vector.

Two aggregations read the table (one profiles the text columns, one finds vocabularies, modes and means). The encoding itself
is one projection of built-in functions, so Catalyst prunes every column that is no feature; its narrow rows are numbered and
written once, and every later pass reads these.

A row whose target is known is *support*; a row whose target is null is a *query*. Vocabularies, modes and means come
from the support rows only (from all rows where there is no target). Nulls are imputed; no row is dropped.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretell.models import gbm
from foretell.plans.ordinal import with_row_id
from foretell.sources.tables import key_of, resolve

MAX_CLASSES, MAX_FEATURES = 10, 100
#: Most levels of a categorical column; share of distinct values (from MIN_FOR_SHARE values on) from which text is no category.
MAX_LEVELS, MAX_DISTINCT_SHARE, MIN_FOR_SHARE = 50, 0.9, 5
#: An estimate of distinct values above this settles that there are more than MAX_LEVELS; below, they are counted exactly.
SURELY_MANY = 500
#: Words that stand for true and false; fixed values.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "t"), ("false", "no", "n", "f")
#: With more support rows than this, equal ones are brought to the driver once, with their number.
MANY_SUPPORT = 50_000
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


class EncodingError(ValueError):
    """A table or target that cannot be encoded."""


def is_word(c: Column) -> Column:
    """Whether a text is a word for true or false, white space around it aside. A long text fails at its first letters."""
    return c.rlike(r"(?i)\A\s*(?:" + "|".join([*TRUE_WORDS, *FALSE_WORDS]) + r")\s*\z")


def word_to_number(c: Column) -> Column:
    """1 for a true word, 0 for a false one, else null; trims spaces only."""
    w = F.lower(F.trim(c))
    return F.when(w.isin(*TRUE_WORDS), 1.0).when(w.isin(*FALSE_WORDS), 0.0)


def text_to_number(c: Column) -> Column:
    """A finite decimal number in text, else null."""
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    n = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def kind_of(t: T.DataType) -> str | None:
    """numeric, boolean, date or text; None for types that are neither feature nor target."""
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text" if isinstance(t, (T.StringType, T.VarcharType, T.CharType)) else None


def number_of(c: Column, t: T.DataType) -> Column:
    """A numeric, boolean or date column as a double; dates as seconds since 1970."""
    if isinstance(t, T.DateType):
        return F.unix_date(c) * 86400.0
    if isinstance(t, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return F.unix_micros(c) / 1e6 if isinstance(t, T.TimestampType) else c.cast("double")


@dataclass
class Encoded:
    """A table as (row_id, support, y, x) with what is known about it."""

    df: DataFrame
    table: DataFrame
    ids: DataFrame
    keys: list[str]
    target: str | None
    features: list[str]
    kinds: list[str]
    levels: dict[str, list[str]]
    notes: list[str]
    target_is_int: bool
    n: int
    n_support: int
    labels: list[str] | None = None
    sample: int | None = None
    _held: dict = field(default_factory=dict)

    @property
    def n_features(self) -> int:
        return len(self.features)

    def base(self) -> DataFrame:
        """The table's rows with their number in __row_id, joined by the key columns, which must tell the rows apart."""
        names = [f"__k{i}" for i in range(len(self.keys))]
        if not self.ids.groupBy(*names).count().filter("count > 1").isEmpty():
            raise EncodingError(f"rows repeat in {', '.join(self.keys)}: give a key= that tells them apart")
        same = F.lit(True)
        for k, c in zip(names, self.keys, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(f"`{c}`"))
        return self.table.join(self.ids.select(F.col("row_id").alias("__row_id"), *names), same).drop(*names)

    def support(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row_id, x, y) of the support rows, in order of row_id, on the driver: all, or, if ``sample`` is set and there are
        more, those of the least hash of their key."""
        if "support" not in self._held:
            rows = self.ids.filter("support")
            if self.sampled:
                cut = rows.select("hash").orderBy("hash").limit(self.sample).agg(F.max("hash")).first()[0]
                rows = rows.filter(F.col("hash") <= cut)
                warnings.warn(f"the model is fitted on {self.sample} of {self.n_support} labeled rows", stacklevel=2)
            rows = rows.orderBy("row_id").select("row_id", "x", "y").toArrow()
            x = np.array(rows.column("x").combine_chunks().flatten() if rows.num_rows else [], float).reshape(rows.num_rows, self.n_features)
            self._held["support"] = rows.column("row_id").to_numpy(), x, np.array(rows.column("y").to_numpy(zero_copy_only=False), float)
        return self._held["support"]

    @property
    def sampled(self) -> bool:
        return self.sample is not None and self.n_support > self.sample

    @property
    def many(self) -> bool:
        return self.n_support > MANY_SUPPORT and not self.sampled

    def grouped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(x, y, number of rows) of the support, on the driver. Of many rows equal ones are counted together, in order of x and y;
        otherwise each stands alone, and the numbers are None."""
        if not self.many:
            return *self.support()[1:], None
        if "grouped" not in self._held:
            rows = self.df.filter("support").groupBy("x", "y").count().orderBy("x", "y").toArrow()
            x = np.array(rows.column("x").combine_chunks().flatten(), float).reshape(rows.num_rows, self.n_features)
            self._held["grouped"] = x, np.array(rows.column("y").to_numpy(), float), rows.column("count").to_numpy()
        return self._held["grouped"]

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(x, sum of the targets, number of rows, unit) of the distinct vectors of the support, the targets as whole numbers of the
        unit: what boosted trees are fitted on."""
        if "summed" not in self._held:
            rows = self.df.filter("support")
            unit = gbm.unit_of(rows.agg(F.max(F.abs("y"))).first()[0])
            rows = rows.groupBy("x").agg(F.sum(F.floor(F.col("y") / F.lit(unit) + 0.5)).alias("s"), F.count("*").alias("n")).orderBy("x").toArrow()
            x = np.array(rows.column("x").combine_chunks().flatten(), float).reshape(rows.num_rows, self.n_features)
            self._held["summed"] = x, rows.column("s").to_numpy().astype(float), rows.column("n").to_numpy(), unit
        return self._held["summed"]

    def queries(self) -> DataFrame:
        return self.df.filter("not support")

    def classes(self) -> list[float]:
        """Distinct known targets, ascending; at most MAX_CLASSES + 1 of them."""
        if "classes" not in self._held:
            found = self.df.filter("support").select("y").distinct().orderBy("y").limit(MAX_CLASSES + 1).collect()
            self._held["classes"] = [r["y"] for r in found]
        return self._held["classes"]

    def is_classification(self) -> bool:
        return self.target_is_int and 2 <= len(self.classes()) <= MAX_CLASSES

    def require_support(self) -> None:
        if self.n_support == 0:
            raise EncodingError("no labeled rows: at least one row needs a known target")


def _target(c: str, t: T.DataType, df: DataFrame, notes: list[str]) -> tuple[Column, bool, list[str] | None]:
    """(expression, whole numbers or classes, labels)."""
    kind = kind_of(t)
    if kind is None:
        raise EncodingError(f'target column "{c}" has type {t.simpleString()}, which cannot be a target')
    if kind != "text":
        return number_of(F.col(f"`{c}`"), t), kind == "boolean" or isinstance(t, T.IntegralType), None
    v = F.col(f"`{c}`")
    seen = df.filter(v.isNotNull()).agg(F.bool_and(is_word(v)).alias("words"), F.bool_and(text_to_number(v).isNotNull()).alias("numbers"), F.count("*").alias("n")).first()
    if seen["words"]:
        notes.append(f'target "{c}": text -> boolean')
        return word_to_number(v), True, None
    if seen["numbers"]:
        notes.append(f'target "{c}": numeric-parseable text -> regression target')
        return text_to_number(v), False, None
    labels = sorted((r[0] for r in df.filter(v.isNotNull()).select(v).distinct().limit(MAX_CLASSES + 1).collect()), key=lambda s: s.encode())
    if len(labels) > MAX_CLASSES:
        raise EncodingError(f'target column "{c}" is text, not numeric, and has more than {MAX_CLASSES} distinct labels: it can be neither classified nor regressed')
    notes.append(f'target "{c}": text -> {len(labels)} classes [{", ".join(f"{i}={x}" for i, x in enumerate(labels))}]')
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), v) if labels else F.lit(None)
    return F.nullif(at, F.lit(0)).cast("double") - 1, True, labels


def encode(table: DataFrame | str, target: str | None = None, key: str | list[str] = (), order_by: str | list[str] = (), sample_support: int | None = None) -> Encoded:
    """Encode a table. ``key`` columns are no features; ``row_id`` numbers the rows in order of ``order_by`` (default: key).

    ``sample_support``: fit models on no more than so many support rows, those of the least hash of their key columns
    (on all if it is not given); all rows are encoded, scored and counted all the same.
    """
    df = resolve(table)
    key = [key] if isinstance(key, str) else list(key)
    if not key and isinstance(table, str):
        key = key_of(table)
    order = [order_by] if isinstance(order_by, str) else list(order_by) or key
    if not order:
        raise EncodingError("rows need an order: give key= or order_by=")
    types = {f.name: f.dataType for f in df.schema}
    if target is not None and target not in types:
        raise EncodingError(f'target column "{target}" not found')
    notes: list[str] = []
    candidates = [c for c in types if c != target and c not in key and kind_of(types[c])]
    texts = [c for c in candidates if kind_of(types[c]) == "text"]
    # Pass 1: counts, and which text columns hold words for true and false.
    col = lambda c: F.col(f"`{c}`")
    aggs = [F.count("*").alias("n")]
    aggs.append((F.count(col(target)) if target else F.count("*")).alias("n_support"))
    for i, c in enumerate(texts):
        aggs += [F.count(col(c)).alias(f"c{i}"), F.approx_count_distinct(col(c)).alias(f"d{i}"), F.bool_and(is_word(col(c))).alias(f"b{i}")]
    first = df.agg(*aggs).first()
    support = col(target).isNotNull() if target else F.lit(True)
    # Pass 2: exact levels of the columns that may be categories; means, modes and numbers of nulls.
    maybe = [c for i, c in enumerate(texts) if first[f"c{i}"] and not first[f"b{i}"] and first[f"d{i}"] <= SURELY_MANY]
    numeric = {c: number_of(col(c), types[c]) for c in candidates if kind_of(types[c]) != "text"}
    numeric |= {c: word_to_number(col(c)) for i, c in enumerate(texts) if first[f"b{i}"]}
    aggs = [F.lit(1).alias("one")]
    for i, c in enumerate(maybe):
        aggs += [F.collect_set(col(c)).alias(f"all{i}"), F.collect_set(F.when(support, col(c))).alias(f"sup{i}"), F.mode(F.when(support, col(c)), True).alias(f"mode{i}")]
    for i, c in enumerate(numeric):
        aggs += [F.avg(F.when(support, numeric[c])).alias(f"mean{i}"), F.sum(numeric[c].isNull().cast("long")).alias(f"null{i}")]
    second = df.groupBy().agg(*aggs).first()
    features, kinds, levels, values, imputed = [], [], {}, [], []
    for c in candidates:
        if c in texts:
            i = texts.index(c)
            if not first[f"c{i}"]:
                notes.append(f"{c}: all-NULL text column dropped")
                continue
            if first[f"b{i}"]:
                notes.append(f"{c}: text -> boolean")
            else:
                known = len(second[f"all{maybe.index(c)}"]) if c in maybe else None
                if known is None or known > MAX_LEVELS or (first[f"c{i}"] >= MIN_FOR_SHARE and known / first[f"c{i}"] > MAX_DISTINCT_SHARE):
                    notes.append(f"{c}: {known if known is not None else f'over {SURELY_MANY}'} distinct text values, dropped")
                    continue
                notes.append(f"{c}: text -> categorical ({known} levels)")
                j = maybe.index(c)
                vocab = sorted(second[f"sup{j}"], key=lambda s: s.encode())
                mode = second[f"mode{j}"]
                code = float(vocab.index(mode)) if vocab else 0.0
                at = F.array_position(F.array(*[F.lit(x) for x in vocab]), col(c)) if vocab else F.lit(0)
                values.append(F.when(col(c).isNull(), code).otherwise(F.coalesce(F.nullif(at, F.lit(0)) - 1, F.lit(len(vocab)))).cast("double"))
                features.append(c)
                kinds.append("categorical")
                levels[c] = vocab
                continue
        i = list(numeric).index(c)
        mean = second[f"mean{i}"] or 0.0
        if second[f"null{i}"]:
            imputed.append(f"{c}: imputed {second[f'null{i}']} missing value(s) (mean={mean:.4f})")
        values.append(F.coalesce(numeric[c], F.lit(mean)))
        features.append(c)
        kinds.append("bool_text" if c in texts else kind_of(types[c]))
    notes += imputed
    if not features:
        raise EncodingError("no usable feature columns: numeric, boolean, date and low-cardinality text columns qualify")
    y, is_int, labels = _target(target, types[target], df, notes) if target else (F.lit(None).cast("double"), False, None)
    columns = key or order
    narrow = df.select(*[col(c).alias(f"__o{i}") for i, c in enumerate(order)], *[col(c).alias(f"__k{i}") for i, c in enumerate(columns)], F.xxhash64(*[col(c) for c in columns]).alias("hash"),
                       support.alias("support") if target else F.lit(True).alias("support"), y.alias("y"), F.array(*values).alias("x"))
    ids = with_row_id(narrow, [f"__o{i}" for i in range(len(order))]).drop(*[f"__o{i}" for i in range(len(order))])
    return Encoded(ids.select("row_id", "support", "y", "x"), df, ids.select("row_id", "support", "y", "x", "hash", *[f"__k{i}" for i in range(len(columns))]), columns, target, features, kinds, levels, notes, is_int, first["n"], first["n_support"], labels, sample_support)
