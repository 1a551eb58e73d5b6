"""The registered queries of the library's own operators, each with its SQL.

Classification queries predict ``labels.quality`` of documents, regressions the retail price of every fifth part or the
balance of every fifth supplier. The SQL (statements.py) states the same steps over the same tables; floats are rounded on both
sides, since sums run in another order. Queries named ``sql_`` call the operators in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import foretell
from foretell.functions import numbers
from foretell.operators import cluster as clusters
from foretell.operators import conformal, explain, neighbors, predict, primitives, view, windows
from foretell.plans import relational
from foretell.plans import statements as st
from foretell.plans.encode import encode
from foretell.sources.shared import new_path
from foretell.sources.tables import columns_of, resolve, save
from foretell.streaming.scoring import score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# The three encoded tables


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality label, null where it is not known."""
    return _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts; the price of every fifth is to be predicted."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return p.withColumn("price", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice"))).drop("p_retailprice")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the number and value of their line items; the balance of every fifth is to be predicted."""
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"))
    s = _read(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left")
    return s.select("s_suppkey", "s_nationkey", "lines", "quantity", "discount", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("balance"))


DOCUMENTS = st.tables("doc_id", "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)", ["lang", "source", "n_chars"], ["lang", "source"], "quality")
PARTS = st.tables("p_partkey", "SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part", ["p_brand", "p_size"], ["p_brand"], "price")
SUPPLIER_ROWS = """SELECT s_suppkey, s_nationkey, lines, quantity, discount, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS balance FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS lines, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey"""
SUPPLIERS = st.tables("s_suppkey", SUPPLIER_ROWS, ["s_nationkey", "lines", "quantity", "discount"], [], "balance")
DOCUMENT_NAMES, SUPPLIER_NAMES = ("lang", "source", "n_chars"), ("s_nationkey", "lines", "quantity", "discount")


def named(place: str, names: tuple[str, ...]) -> str:
    return f"CASE {place} " + " ".join(f"WHEN {j} THEN '{n}'" for j, n in enumerate(names)) + " END"


# Encoding and tasks

ENCODE = st.chain(DOCUMENTS) + " SELECT row_id, support, y, x0, x1, x2 FROM enc"


@query(ENCODE)
def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encode(documents(spark, sf_dir), "quality", key="doc_id")
    return e.df.select("row_id", "support", "y", *[F.col("x")[j].alias(f"x{j}") for j in range(e.n_features)])


@query(
    """SELECT 'documents' AS tbl, 'classify (' || (SELECT count(DISTINCT quality) FROM labels) || ' classes, ' || (SELECT count(quality) FROM labels) || ' labeled rows, 3 features)' AS task
UNION ALL SELECT 'parts', 'regress (' || (SELECT count(*) FROM part WHERE p_partkey % 5 <> 0) || ' labeled rows, 2 features)'
UNION ALL SELECT 'sizes', 'regress (' || (SELECT count(*) FROM part) || ' labeled rows, 2 features)'"""
)
def detect_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    rows = [
        ("documents", predict.detect_task(documents(spark, sf_dir), "quality", key="doc_id")),
        ("parts", predict.detect_task(p, "price", key="p_partkey")),
        ("sizes", predict.detect_task(p.withColumn("price", F.coalesce("price", F.lit(0.0))), "p_size", key="p_partkey")),
    ]
    return spark.createDataFrame(rows, "tbl string, task string")


@query("SELECT column_name AS name, CASE column_name WHEN 'vec_id' THEN 'bigint' WHEN 'label' THEN 'int' ELSE 'array<float>' END AS type, CASE column_name WHEN 'embedding' THEN NULL ELSE 'numeric' END AS kind, false AS is_key, CAST(row_number() OVER () - 1 AS INT) AS place FROM (DESCRIBE embeddings)")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns_of(f"{sf_dir}/embeddings.parquet")


# Classification

PREDICTED = (DOCUMENTS, st.kernel("known", "unknown", 3), "best AS (SELECT row_id, arg_max(c, (p, -c)) AS prediction, max(p) AS confidence FROM prob GROUP BY row_id)")


@query(st.chain(*PREDICTED) + " SELECT row_id, prediction, round(confidence, 6) AS confidence, 'classify' AS task FROM best")
def automl_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(predict.automl(documents(spark, sf_dir), "quality", key="doc_id"), "confidence")


@query(st.chain(*PREDICTED) + " SELECT row_id, prediction AS imputed FROM best")
def impute_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.impute(documents(spark, sf_dir), "quality", key="doc_id")


@query(st.chain(*PREDICTED, st.trust(3)) + " SELECT row_id, prediction, round(confidence, 6) AS confidence, round(trust, 6) AS trust, ood, 'classify' AS task FROM best JOIN trust USING (row_id)")
def predict_trust_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(predict.predict_trust(documents(spark, sf_dir), "quality", key="doc_id"), "confidence", "trust")


@query(st.chain(DOCUMENTS, st.kernel("known", "known", 3)) + " SELECT row_id, round(1 - p, 6) AS score, 1 - p > 0.5 AS is_outlier FROM prob WHERE c = y")
def anomaly_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(predict.anomaly(documents(spark, sf_dir), "quality", key="doc_id"), "score")


HALVES = "ord AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM known), ctx AS (SELECT * FROM ord WHERE pos % 2 = 0), cal AS (SELECT * FROM ord WHERE pos % 2 = 1)"
THRESHOLD = st.chain(DOCUMENTS, HALVES, st.kernel("ctx", "cal", 3)) + " SELECT round(least(greatest(1 - quantile_cont(1 - p, 0.9), 0), 1), 6) AS threshold FROM prob WHERE c = y"


@query(THRESHOLD)
def conformal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = conformal.conformal_threshold(documents(spark, sf_dir), "quality", 0.9, key="doc_id")
    return spark.createDataFrame([(round(t, 6),)], "threshold double")


def turned(nf: int) -> str:
    """variants(j, row_id, y, x...): the known rows as they are (j = -1), and with one feature after the other in reverse order."""
    out = ["turn AS (SELECT *, row_number() OVER (ORDER BY row_id) AS a, row_number() OVER (ORDER BY row_id DESC) AS b FROM known), variants AS (SELECT -1 AS j, row_id AS of_row, y, " + ", ".join(f"x{i}" for i in range(nf)) + " FROM known"]
    out += [f" UNION ALL SELECT {j}, k.row_id, k.y, " + ", ".join(f"{'r' if i == j else 'k'}.x{i}" for i in range(nf)) + " FROM turn k JOIN turn r ON r.a = k.b" for j in range(nf)]
    return "".join(out) + "), asked AS (SELECT *, (j + 1) * 10000000 + of_row AS row_id FROM variants)"


ACCURACY = (DOCUMENTS, turned(3), st.kernel("known", "asked", 3), """best AS (SELECT row_id, any_value(y) AS y, arg_max(c, (p, -c)) AS c FROM prob GROUP BY row_id)
, acc AS (SELECT j, avg(CASE WHEN c = best.y THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM best JOIN asked USING (row_id) GROUP BY j)
, imp AS (SELECT j, greatest((SELECT acc FROM acc WHERE j = -1) - acc, 0) AS imp FROM acc WHERE j >= 0)""")  # fmt: skip


@query(st.chain(*ACCURACY) + f" SELECT {named('j', DOCUMENT_NAMES)} AS feature, round(imp, 6) AS importance FROM imp")
def importance_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explain.importance(documents(spark, sf_dir), "quality", key="doc_id"), "importance")


def _cases(nf: int, baselines: str) -> str:
    """cases(row_id, y, x...): the first row (-1), and with one feature after the other at its baseline b0, b1, ..."""
    out = f"base_row AS (SELECT {baselines}), cases AS (SELECT -1 AS row_id, y, {', '.join(f'x{i}' for i in range(nf))} FROM enc WHERE row_id = 1"
    return out + "".join(f" UNION ALL SELECT {j}, y, " + ", ".join(f"b{i}" if i == j else f"x{i}" for i in range(nf)) + " FROM enc, base_row WHERE row_id = 1" for j in range(nf)) + ")"


def _commonest(j: int) -> str:
    return f"(SELECT x{j} FROM known GROUP BY x{j} ORDER BY count(*) DESC, x{j} LIMIT 1) AS b{j}"


EXPLAIN_ROW = (
    st.chain(DOCUMENTS, _cases(3, f"{_commonest(0)}, {_commonest(1)}, (SELECT avg(x2) FROM known) AS b2"), st.kernel("known", "cases", 3))
    + f""", top AS (SELECT arg_max(c, (p, -c)) AS c, max(p) AS p FROM prob WHERE row_id = -1)
, contrib AS (SELECT prob.row_id AS j, top.p - prob.p AS contribution FROM prob JOIN top USING (c) WHERE prob.row_id >= 0)
SELECT {named("j", DOCUMENT_NAMES)} AS feature, round(contribution, 6) AS contribution,
       CASE WHEN contribution >= 0 THEN 'toward' ELSE 'away' END AS direction,
       CASE j WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS value
FROM contrib, (SELECT * FROM enc WHERE row_id = 1)"""
)


@query(EXPLAIN_ROW)
def explain_row_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explain.explain_row(documents(spark, sf_dir), "quality", 1, key="doc_id"), "contribution")


def lean(names: tuple[str, ...]) -> str:
    """The sentence on what the fit leans on, from imp(j, imp)."""
    one = f"{named('j', names)} || ' (' || printf('%.3f', imp) || ')'"
    return f"""coalesce((SELECT ' The fit leans on ' || string_agg({one}, ' and ' ORDER BY imp DESC, j) || '.' FROM (SELECT * FROM imp WHERE imp > 0 ORDER BY imp DESC, j LIMIT 2)),
  ' Reversing any one feature leaves the fit as good as it was.')"""


@query(
    st.chain(*ACCURACY)
    + f""" SELECT (SELECT count(*) FROM known) || ' rows say quality, ' || (SELECT count(*) FROM unknown) || ' do not: which of ' || (SELECT count(DISTINCT y) FROM known) || ' classes (Gaussian kernel).'
  || {lean(DOCUMENT_NAMES)} || ' Encoding: text: ' || (SELECT CASE WHEN count(DISTINCT text) > 500 THEN 'over 500' ELSE CAST(count(DISTINCT text) AS VARCHAR) END FROM documents) || ' distinct text values, dropped'
  || '; lang: text -> categorical (' || (SELECT count(DISTINCT lang) FROM documents) || ' levels); source: text -> categorical (' || (SELECT count(DISTINCT source) FROM documents) || ' levels).' AS story"""
)
def explain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(explain.explain(documents(spark, sf_dir), "quality", key="doc_id"),)], "story string")


LABELS = "CASE WHEN trust IS NULL THEN NULL WHEN ood OR trust < 0.34 THEN 'low trust' WHEN trust < 0.67 THEN 'check' ELSE 'trusted' END AS trust_label"


@query(
    st.chain(*PREDICTED, st.trust(3), st.kernel("known", "known", 3, "own", "k_"), "scored AS (SELECT row_id, 1 - p AS score FROM own WHERE c = y)")
    + f""" SELECT doc_id, round(score, 6) AS anomaly_score, prediction AS predicted, round(confidence, 6) AS confidence, round(trust, 6) AS trust, ood, {LABELS}, CAST(NULL AS DOUBLE) AS band
FROM base LEFT JOIN scored USING (row_id) LEFT JOIN best USING (row_id) LEFT JOIN trust USING (row_id)"""
)
def view_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view.view_frame(documents(spark, sf_dir), "quality", "anomaly,predict", key="doc_id")
    return _rounded(df.select("doc_id", "anomaly_score", "predicted", "confidence", "trust", "ood", "trust_label", "band"), "anomaly_score", "confidence", "trust")


# Regression

PRICED = (PARTS, st.boosted("known", 2), st.boosted_values("unknown", 2, "pred"), st.standard("known", 2), st.trust(2))
PRICE = f"{st.rounded('value', st.decimals('known', 'y'))}"


@query(st.chain(*PRICED) + f" SELECT row_id, {PRICE} AS prediction, round(trust, 6) AS confidence, 'regress' AS task FROM pred JOIN trust USING (row_id)")
def automl_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(predict.automl(parts(spark, sf_dir), "price", key="p_partkey"), "confidence")


@query(st.chain(*PRICED[:3]) + f" SELECT row_id, {PRICE} AS imputed FROM pred")
def impute_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.impute(parts(spark, sf_dir), "price", key="p_partkey")


BALANCED = (SUPPLIERS, st.boosted("known", 4), st.boosted_values("unknown", 4, "pred"))
TRUSTED = (st.standard("known", 4), st.trust(4))


@query(st.chain(*BALANCED, *TRUSTED) + " SELECT row_id, round(value, 6) AS prediction, round(trust, 6) AS confidence, round(trust, 6) AS trust, ood, 'regress' AS task FROM pred JOIN trust USING (row_id)")
def predict_trust_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(predict.predict_trust(suppliers(spark, sf_dir), "balance", key="s_suppkey"), "prediction", "confidence", "trust")


RESIDUALS = (st.boosted_values("known", 4, "own"), "resid AS (SELECT row_id, abs(y - value) AS r FROM own JOIN known USING (row_id)), scored AS (SELECT row_id, (r - avg(r) OVER ()) / greatest(stddev_pop(r) OVER (), 1e-9) AS score FROM resid)")


@query(st.chain(SUPPLIERS, st.boosted("known", 4), *RESIDUALS) + " SELECT row_id, round(score, 6) AS score, score > 2 AS is_outlier FROM scored")
def anomaly_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(predict.anomaly(suppliers(spark, sf_dir), "balance", key="s_suppkey"), "score")


HALF_WIDTH = (HALVES, st.boosted("ctx", 4, "h_"), st.boosted_values("cal", 4, "half", "h_"))
WIDTH = "(SELECT quantile_cont(abs(y - value), {0}) FROM half JOIN cal USING (row_id))"


@query(st.chain(*BALANCED, *HALF_WIDTH) + f" SELECT row_id, round(value, 6) AS prediction, round(value - q, 6) AS lo, round(value + q, 6) AS hi FROM pred, (SELECT {WIDTH.format(0.9)} AS q)")
def conformal_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(conformal.conformal_regress(suppliers(spark, sf_dir), "balance", 0.9, key="s_suppkey"), "prediction", "lo", "hi")


LOSSES = (turned(4), st.boosted_values("asked", 4, "guess"), """mse AS (SELECT j, avg(pow(value - y, 2)) AS mse FROM guess JOIN asked USING (row_id) GROUP BY j)
, imp AS (SELECT j, greatest((mse - (SELECT mse FROM mse WHERE j = -1)) / ((SELECT mse FROM mse WHERE j = -1) + 1e-9), 0) AS imp FROM mse WHERE j >= 0)""")  # fmt: skip


@query(st.chain(SUPPLIERS, st.boosted("known", 4), *LOSSES) + f" SELECT {named('j', SUPPLIER_NAMES)} AS feature, round(imp, 6) AS importance FROM imp")
def importance_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explain.importance(suppliers(spark, sf_dir), "balance", key="s_suppkey"), "importance")


EXPLAIN_VALUE = (
    st.chain(SUPPLIERS, st.boosted("known", 4), _cases(4, ", ".join(f"(SELECT avg(x{j}) FROM known) AS b{j}" for j in range(4))), st.boosted_values("cases", 4, "guess"))
    + f""", contrib AS (SELECT row_id AS j, (SELECT value FROM guess WHERE row_id = -1) - value AS contribution FROM guess WHERE row_id >= 0)
SELECT {named("j", SUPPLIER_NAMES)} AS feature, round(contribution, 6) AS contribution, CASE WHEN contribution >= 0 THEN 'increases' ELSE 'decreases' END AS direction,
       CASE j WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS value
FROM contrib, (SELECT * FROM enc WHERE row_id = 1)"""
)


@query(EXPLAIN_VALUE)
def explain_row_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explain.explain_row(suppliers(spark, sf_dir), "balance", 1, key="s_suppkey"), "contribution")


SHOWN = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
DECIMALS = st.decimals("known", "y")


@query(
    st.chain(*BALANCED, *TRUSTED, *HALF_WIDTH, *LOSSES, f"""example AS (
  SELECT row_id, {st.rounded("value", DECIMALS)} AS value, {st.rounded(WIDTH.format(0.8), DECIMALS)} AS band, CASE WHEN ood OR trust < 0.34 THEN 'low trust, as no known row is near it' WHEN trust < 0.67 THEN 'check' ELSE 'trusted' END AS label
  FROM pred JOIN trust USING (row_id) ORDER BY row_id LIMIT 1)""")  # fmt: skip
    + f""" SELECT (SELECT count(*) FROM known) || ' rows say balance, ' || (SELECT count(*) FROM unknown) || ' do not: a number (boosted trees).' || {lean(SUPPLIER_NAMES)}
  || ' Row ' || row_id || ' would get ' || {SHOWN.format("value")} || ', give or take ' || {SHOWN.format("band")} || ' in four of five cases [' || label || '].'
  || (SELECT coalesce(' Encoding: ' || string_agg(note, '; ' ORDER BY j) || '.', '') FROM (
       {" UNION ALL ".join(f"SELECT {j} AS j, '{n}: imputed ' || count(*) FILTER ({n} IS NULL) || ' missing value(s) (mean=' || printf('%.4f', avg({n}) FILTER (support)) || ')' AS note FROM base HAVING count(*) FILTER ({n} IS NULL) > 0" for j, n in enumerate(SUPPLIER_NAMES))})) AS story
FROM example"""
)
def explain_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(explain.explain(suppliers(spark, sf_dir), "balance", key="s_suppkey"),)], "story string")


def draws(k: int) -> list[float]:
    return [*islice(clusters.draws(), k)]


def in_rows(nf: int, table: str = "enc") -> str:
    """The features of an encoded table in rows, as one group."""
    return " UNION ALL ".join(f"SELECT 0 AS g, row_id, {j} AS j, x{j} AS x FROM {table}" for j in range(nf))


VIEW = (
    st.chain(*BALANCED, *TRUSTED, *RESIDUALS, *HALF_WIDTH, st.kmeans(in_rows(4), 4, 3, clusters.ROUNDS, draws(3)))
    + f""" SELECT s_suppkey, s_nationkey, lines, quantity, discount, balance, label AS cluster, round(score, 6) AS anomaly_score,
  {st.rounded("value", DECIMALS)} AS predicted, round(trust, 6) AS confidence, round(trust, 6) AS trust, ood, {LABELS},
  CASE WHEN value IS NOT NULL THEN {st.rounded(WIDTH.format(0.8), DECIMALS)} END AS band
FROM base JOIN label USING (row_id) LEFT JOIN scored USING (row_id) LEFT JOIN pred USING (row_id) LEFT JOIN trust USING (row_id)"""
)


@query(VIEW)
def view_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(view.view_frame(suppliers(spark, sf_dir), "balance", key="s_suppkey"), "anomaly_score", "confidence", "trust")


@query(VIEW)
def create_and_refresh_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by name: made from the known rows only, and made anew when the others have come."""
    s = suppliers(spark, sf_dir)
    s.filter("balance is not null").createOrReplaceTempView("ft_suppliers")
    view.create_view("ft_suppliers", "balance", materialized=False, key="s_suppkey")
    s.createOrReplaceTempView("ft_suppliers")
    view.refresh_view("ft_suppliers_ml")
    return _rounded(spark.table("ft_suppliers_ml"), "anomaly_score", "confidence", "trust")


# Streams and formats


@query(st.chain(*PREDICTED, st.trust(3)) + " SELECT doc_id, prediction, round(confidence, 6) AS confidence, round(trust, 6) AS trust, ood FROM base JOIN best USING (row_id) JOIN trust USING (row_id)")
def stream_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label as a stream, scored against those with one, and read back from the stream's sink."""
    known = documents(spark, sf_dir).filter("quality is not null")
    table = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(known.select("doc_id"), "doc_id", "left_anti")
    arriving, sink = new_path(spark, "arriving"), new_path(spark, "stream")
    table.write.parquet(arriving)
    stream = spark.readStream.schema(table.schema).parquet(arriving)
    scores = score_stream(stream, known.select("doc_id", "lang", "source", "n_chars", "quality"), "quality", ["doc_id"])
    q = scores.writeStream.format("parquet").option("checkpointLocation", f"{sink}/progress").trigger(availableNow=True).start(f"{sink}/rows")
    q.awaitTermination()
    return _rounded(spark.read.parquet(f"{sink}/rows"), "confidence", "trust")


@query("SELECT format, count(*) AS n, round(sum(s_acctbal), 2) AS balance, min(s_name) AS first FROM supplier, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) f(format) GROUP BY format")
def formats_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written in each format and read by the path's suffix."""
    out, folder = None, new_path(spark, "formats")
    for kind in ("parquet", "orc", "json", "csv"):
        s = _read(spark, sf_dir, "supplier")
        save(s, f"{folder}/s.{kind}", kind)
        back = resolve(f"{folder}/s.{kind}").select(F.lit(kind).alias("format"), "s_name", "s_acctbal")
        out = back if out is None else out.unionByName(back)
    return out.groupBy("format").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"), F.min("s_name").alias("first"))


# Neighbours, clusters, windows


def _similar_sql(k: int = 5) -> str:
    return f"""
WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sd FROM s GROUP BY i),
z AS (SELECT vec_id, i, (v - m) / sd AS z FROM s JOIN st USING (i)),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS support_id, sqrt(sum(pow(a.z - b.z, 2))) AS distance FROM z a JOIN z b USING (i) WHERE a.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, support_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INT) AS rank, support_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}"""


@query(_similar_sql())
def similar_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return _rounded(neighbors.similar(e, e.filter("vec_id % 100 = 0"), 5, "embedding", "vec_id", "vec_id"), "distance")


SUPPLIER_CLUSTERS = st.chain("numbered AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS row_id FROM supplier)", st.kmeans("SELECT 0 AS g, row_id, 0 AS j, s_nationkey AS x FROM numbered UNION ALL SELECT 0, row_id, 1, s_acctbal FROM numbered", 2, 3, clusters.ROUNDS, draws(3))) + " SELECT row_id, label AS cluster FROM label"


@query(SUPPLIER_CLUSTERS)
def cluster_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_read(spark, sf_dir, "supplier").drop("s_name"), 3, key="s_suppkey")


@query(st.chain(DOCUMENTS, st.kmeans(in_rows(3), 3, 4, clusters.ROUNDS, draws(4))) + " SELECT row_id, label AS cluster FROM label")
def cluster_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(documents(spark, sf_dir), 4, "quality", key="doc_id")


CLUSTER_OVER = st.chain(st.kmeans("SELECT label AS g, vec_id AS row_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding) AS x FROM embeddings", 64, 3, clusters.ROUNDS, draws(3))) + " SELECT row_id AS vec_id, g AS label, label.label AS cluster FROM label"


@query(CLUSTER_OVER)
def cluster_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return clusters.cluster_over(e, "embedding", ["label"]).select("vec_id", "label", "cluster")


@query(
    """WITH s AS (SELECT p_partkey, p_size, p_retailprice, avg(p_size) OVER () AS m0, stddev_pop(p_size) OVER () AS s0, avg(p_retailprice) OVER () AS m1, stddev_pop(p_retailprice) OVER () AS s1 FROM part)
SELECT p_partkey, round(sqrt((pow((p_size - m0) / s0, 2) + pow((p_retailprice - m1) / s1, 2)) / 2), 6) AS score FROM s"""
)
def anomaly_over_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one window."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return _rounded(windows.anomaly_over(p, ["p_size", "p_retailprice"]), "score").select("p_partkey", "score")


ANOMALY_OVER = """WITH s AS (SELECT event_id, value, avg(value) OVER w AS m, CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END AS sd FROM events WINDOW w AS (PARTITION BY event_type))
SELECT event_id, round(sqrt(pow((value - m) / sd, 2)), 6) AS score FROM s"""


@query(ANOMALY_OVER)
def anomaly_over_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return _rounded(windows.anomaly_over(e, ["value"], ["event_type"]), "score").select("event_id", "score")


@query(
    """WITH s AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
, z AS (SELECT vec_id, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END AS z FROM s WINDOW w AS (PARTITION BY label, i))
SELECT vec_id, round(sqrt(sum(z * z) / count(*)), 6) AS score FROM z GROUP BY vec_id"""
)
def anomaly_over_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windows.anomaly_over(_read(spark, sf_dir, "embeddings"), "embedding", ["label"]), "score").select("vec_id", "score")


# Functions on arrays and numbers


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS argmax, CAST(list_max(embedding) AS DOUBLE) AS confidence FROM embeddings")
def argmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return _read(spark, sf_dir, "embeddings").select("vec_id", numbers.argmax(v).alias("argmax"), numbers.confidence(v).alias("confidence"))


@query(
    """SELECT s_suppkey, CASE WHEN abs(round(s_acctbal, 0) - s_acctbal) <= greatest(abs(s_acctbal) * 1e-9, 1e-9) THEN 0 WHEN abs(round(s_acctbal, 1) - s_acctbal) <= greatest(abs(s_acctbal) * 1e-9, 1e-9) THEN 1
 WHEN abs(round(s_acctbal, 2) - s_acctbal) <= greatest(abs(s_acctbal) * 1e-9, 1e-9) THEN 2 ELSE 6 END AS decimals, round(s_acctbal, 1) AS rounded FROM supplier"""
)
def decimal_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("s_acctbal")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", numbers.decimal_places(c).alias("decimals"), numbers.round_to(c, 1).alias("rounded"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 6) AS q90 FROM orders GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(numbers.quantile(F.col("o_totalprice"), 0.9), 6).alias("q90"))


@query("SELECT 100 AS max_features, 10 AS max_classes, NULL::INT AS dim, NULL::INT AS n_layers, NULL::INT AS n_heads, NULL::INT AS n_landmarks")
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primitives.caps()


@query(f"SELECT '{foretell.__version__}' AS version, 'classifier: Gaussian kernel over standardised rows, up to 100 features and 10 classes; regressor: 100 boosted trees of depth 4' AS model")
def version_and_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foretell.sql import sql

    return sql(spark, "SELECT ft_version() AS version, ft_model_info() AS model")


#: Suppliers of even and odd numbers as two classes of nation and balance, and two queries.
ARRAYS = """enc AS (SELECT s_suppkey AS row_id, true AS support, CAST(s_suppkey % 2 AS DOUBLE) AS y, CAST(s_nationkey AS DOUBLE) AS x0, s_acctbal AS x1 FROM supplier)
, known AS (SELECT * FROM enc), q AS (SELECT * FROM (VALUES (-2, NULL::DOUBLE, 3.0::DOUBLE, 100.0::DOUBLE), (-1, NULL, 20.0, 7000.0)) v(row_id, y, x0, x1))"""


@query(
    st.chain(ARRAYS, st.kernel("known", "q", 2))
    + """, gaps AS (SELECT (row_id + 2) * 2 + c AS place, p FROM prob), near AS (SELECT row_number() OVER (ORDER BY e.row_id) - 1 AS idx, sqrt(pow((e.x0 - q.x0) / s0, 2) + pow((e.x1 - q.x1) / s1, 2)) AS d FROM enc e, q, st WHERE q.row_id = -2)
SELECT 'probability' AS name, CAST(place AS INT) AS place, round(p, 6) AS value FROM gaps
UNION ALL SELECT 'gated', 0, CASE WHEN max(p) >= 0.4 THEN arg_max(place, (p, -place)) END FROM gaps WHERE place < 2
UNION ALL SELECT 'gated high', 0, CASE WHEN max(p) >= 0.999 THEN arg_max(place, (p, -place)) END FROM gaps WHERE place < 2
UNION ALL SELECT 'argmax', 0, arg_max(place, (p, -place)) FROM gaps WHERE place < 2
UNION ALL SELECT 'confidence', 0, round(max(p), 6) FROM gaps WHERE place < 2
UNION ALL (SELECT 'near', CAST(idx AS INT), round(d, 6) FROM near ORDER BY d, idx LIMIT 3)"""
)
def classify_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions on arrays, in SQL, over arrays of a table's rows."""
    from foretell.sql import register

    register(spark)
    s = _read(spark, sf_dir, "supplier").select(F.struct("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), F.col("s_acctbal").alias("b")).alias("r"))
    s.agg(F.sort_array(F.collect_list("r")).alias("rows")).selectExpr("flatten(transform(rows, r -> array(r.a, r.b))) AS s", "transform(rows, r -> cast(r.s_suppkey % 2 as int)) AS y").createOrReplaceTempView("ft_arrays")
    spark.sql("SELECT ft_classify(array(3D, 100D, 20D, 7000D), s, y, 2, 2) AS p, ft_classify_gated(array(3D, 100D), s, y, 2, 2, 0.4D) AS g, ft_classify_gated(array(3D, 100D), s, y, 2, 2, 0.999D) AS h FROM ft_arrays").createOrReplaceTempView("ft_found")
    return spark.sql("""SELECT 'probability' AS name, pos AS place, round(v, 6) AS value FROM ft_found LATERAL VIEW posexplode(p) AS pos, v
      UNION ALL SELECT 'gated', 0, cast(g AS double) FROM ft_found UNION ALL SELECT 'gated high', 0, cast(h AS double) FROM ft_found
      UNION ALL SELECT 'argmax', 0, cast(ft_argmax(slice(p, 1, 2)) AS double) FROM ft_found UNION ALL SELECT 'confidence', 0, round(ft_confidence(slice(p, 1, 2)), 6) FROM ft_found
      UNION ALL SELECT 'near', support_idx, round(distance, 6) FROM ft_arrays, LATERAL ft_similar(array(3D, 100D), s, 2, 3)""")


@query(
    st.chain("known AS (SELECT s_suppkey AS row_id, s_acctbal AS y, CAST(s_nationkey AS DOUBLE) AS x0 FROM supplier), q AS (SELECT * FROM (VALUES (-2, 3.0::DOUBLE), (-1, 20.0)) v(row_id, x0))", st.boosted("known", 1), st.boosted_values("q", 1, "pred"), st.boosted_values("known", 1, "own"))
    + " SELECT CAST(row_id + 2 AS INT) AS place, round(value, 6) AS mean, round((SELECT sqrt(sum(pow(y - value, 2)) / (count(*) - 1)) FROM own JOIN known USING (row_id)), 6) AS deviation FROM pred"
)
def regress_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foretell.sql import register

    register(spark)
    s = _read(spark, sf_dir, "supplier").select(F.struct("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), F.col("s_acctbal").alias("b")).alias("r"))
    s.agg(F.sort_array(F.collect_list("r")).alias("rows")).selectExpr("transform(rows, r -> r.a) AS s", "transform(rows, r -> r.b) AS y").createOrReplaceTempView("ft_pairs")
    return spark.sql("SELECT place, round(p[2 * place], 6) AS mean, round(p[2 * place + 1], 6) AS deviation FROM (SELECT ft_regress(array(3D, 20D), s, y, 1) AS p FROM ft_pairs) LATERAL VIEW explode(array(0, 1)) AS place")


# The operators in SQL


def _in_sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    from foretell.sql import sql

    suppliers(spark, sf_dir).createOrReplaceTempView("ft_suppliers")
    documents(spark, sf_dir).createOrReplaceTempView("ft_documents")
    for name in ("supplier", "embeddings", "events"):
        _read(spark, sf_dir, name).createOrReplaceTempView(f"ft_table_{name}")
    return sql(spark, statement)


IN_SQL = {
    "sql_automl": ("automl_classify", "SELECT row_id, prediction, round(confidence, 6) AS confidence, task FROM ft_automl('ft_documents', 'quality', key => 'doc_id')"),
    "sql_impute": ("impute_classify", "SELECT * FROM ft_impute('ft_documents', 'quality', key => 'doc_id')"),
    "sql_anomaly": ("anomaly_regress", "SELECT row_id, round(score, 6) AS score, is_outlier FROM ft_anomaly('ft_suppliers', 'balance', key => 's_suppkey')"),
    "sql_predict_trust": ("predict_trust_regress", "SELECT row_id, round(prediction, 6) AS prediction, round(confidence, 6) AS confidence, round(trust, 6) AS trust, ood, task FROM ft_predict_trust('ft_suppliers', 'balance', key => 's_suppkey')"),
    "sql_importance": ("importance_regress", "SELECT feature, round(importance, 6) AS importance FROM ft_importance('ft_suppliers', 'balance', key => 's_suppkey')"),
    "sql_explain_row": ("explain_row_regress", "SELECT feature, round(contribution, 6) AS contribution, direction, value FROM ft_explain_row('ft_suppliers', 'balance', 1, key => 's_suppkey')"),
    "sql_conformal_regress": ("conformal_regress", "SELECT row_id, round(prediction, 6) AS prediction, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ft_conformal_regress('ft_suppliers', 'balance', 0.9, key => 's_suppkey')"),
    "sql_conformal_threshold": ("conformal_threshold", "SELECT round(ft_conformal_threshold('ft_documents', 'quality', 0.9, key => 'doc_id'), 6) AS threshold"),
    "sql_cluster_ex": ("cluster_exclude", "SELECT * FROM ft_cluster_ex('ft_documents', 4, 'quality', key => 'doc_id')"),
    "sql_cluster_over": ("cluster_over", "SELECT vec_id, label, cluster FROM ft_cluster_over('ft_table_embeddings', 'embedding', 'label')"),
    "sql_anomaly_over": ("anomaly_over_partition", "SELECT event_id, round(score, 6) AS score FROM ft_anomaly_over('ft_table_events', 'value', 'event_type')"),
    "sql_explain": ("explain_regress", "SELECT ft_explain('ft_suppliers', 'balance', key => 's_suppkey') AS story"),
}
for _name, (_same, _statement) in IN_SQL.items():
    QUERIES[_name] = lambda spark, sf_dir, statement=_statement: _in_sql(spark, sf_dir, statement)
    SQL[_name] = SQL[_same]


@query(
    "SELECT t.task, c.* FROM (SELECT 'regress (' || (SELECT count(*) FROM supplier WHERE s_suppkey % 5 <> 0) || ' labeled rows, 4 features)' AS task) t, (SELECT cluster, count(*) AS n FROM (" + SUPPLIER_CLUSTERS + ") GROUP BY cluster) c"
)
def sql_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators inside a larger statement."""
    _read(spark, sf_dir, "supplier").drop("s_name").createOrReplaceTempView("ft_bare")
    return _in_sql(spark, sf_dir, "SELECT ft_detect_task('ft_suppliers', 'balance', key => 's_suppkey') AS task, cluster, count(*) AS n FROM ft_cluster('ft_bare', 3, key => 's_suppkey') GROUP BY cluster")


def queries() -> dict[str, Callable]:
    return QUERIES | relational.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | relational.SQL
