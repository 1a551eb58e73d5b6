"""Relational queries around the predictive operators: joins, grouping, sets, windows, arrays, maps and JSON, in the DataFrame API.

Filters and projections come first, so that scans read few columns and rows; no side is broadcast by hand, as Spark does so
by size, and skewed joins are split at run time (adaptive execution). Range and as-of joins are those of joins.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretell.plans.joins import as_of, range_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def rel_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.filter("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query(
    """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10"""
)
def rel_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = _t(spark, sf_dir, "customer", "orders", "lineitem")
    segment = c.agg(F.min("c_mktsegment").alias("segment"))
    c = c.join(segment, F.col("c_mktsegment") == F.col("segment"), "left_semi").select("c_custkey")
    joined = c.join(o, c.c_custkey == o.o_custkey).join(li, li.l_orderkey == o.o_orderkey)
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return joined.groupBy("o_orderkey", "o_orderdate").agg(revenue).orderBy(F.desc("revenue"), "o_orderkey").limit(10).select("o_orderkey", "revenue", "o_orderdate")


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def rel_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0)), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)")
def rel_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = _t(spark, sf_dir, "part", "lineitem")
    return p.join(li.filter("l_quantity >= 50"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS INT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderpriority").cast("int").alias("level"))


@query("SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def rel_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, n = _t(spark, sf_dir, "supplier", "customer", "nation")
    both = s.select(F.col("s_nationkey").alias("nationkey")).union(c.select("c_nationkey")).distinct()
    return both.exceptAll(n.filter("n_regionkey = 0").select("n_nationkey")).distinct()


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def rel_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey)::VARCHAR AS keys FROM orders GROUP BY o_custkey")
def rel_ordered_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    pairs = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    keys = F.transform(pairs, lambda p: p["o_orderkey"].cast("string"))
    return o.groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(keys, ", "), F.lit("]")).alias("keys"))


@query("SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) AS t")
def rel_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("region", "nation"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"rel_{name}")
    return spark.sql("SELECT r_name, n_name FROM rel_region, LATERAL (SELECT n_name FROM rel_nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2)")


@query("SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(CAST(v AS DOUBLE), 6) AS value FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE v > 0.3")
def rel_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("pos", "v")).filter("v > 0.3").select("vec_id", "pos", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour FROM events GROUP BY event_type, date_trunc('hour', ts)")
def rel_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "events")
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm")
    return e.groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    (o,) = _t(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def rel_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    (li,) = _t(spark, sf_dir, "lineitem")
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_linenumber")], []]
    return li.groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, count(*) AS near FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal BETWEEN s_acctbal - 500 AND s_acctbal + 500 GROUP BY s_suppkey")
def rel_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a supplier's nation whose balance is within 500 of its own."""
    s, c = _t(spark, sf_dir, "supplier", "customer")
    ranges = s.select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 500).alias("low"), (F.col("s_acctbal") + 500).alias("high"))
    points = c.select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    return range_join(points, ranges, "c_acctbal", "low", "high", 1000.0, ["nation"]).groupBy("s_suppkey").agg(F.count("*").alias("near"))


@query(
    """SELECT p.event_id, p.user_id, c.event_id AS click_id, c.value AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""
)
def rel_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest click before it."""
    (e,) = _t(spark, sf_dir, "events")
    purchases = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("clicked"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return as_of(purchases, clicks, "ts", "clicked", ["user_id"]).select("event_id", "user_id", "click_id", "click_value")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, max(json_extract_string(props, '$.missing')) AS missing FROM events GROUP BY 1, 2")
def rel_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return e.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.max(F.get_json_object("props", "$.missing")).alias("missing"))


@query("SELECT event_type, string_agg(k || '=' || n, ',' ORDER BY k) AS counts, count(*) AS keys FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def rel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by key as a map, and its entries in order."""
    (e,) = _t(spark, sf_dir, "events")
    k = F.map_values(F.from_json("props", "map<string, bigint>"))[0]
    counted = e.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))
    maps = counted.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string")))
    return maps.select("event_type", F.array_join(entries, ",").alias("counts"), F.size("m").cast("long").alias("keys"))
