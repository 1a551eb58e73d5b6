"""Joins that Spark has no operator for, and joins on hot keys, as compositions of its own joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretell.sources.shared import written

#: Rows of one key that a task of a join is meant to take; a key with more is dealt to several.
KEY_ROWS = 100_000
#: Hot keys up to which the table of them is broadcast; there are fewer than rows / KEY_ROWS.
MOST_HOT = 100_000


def spread_join(many: DataFrame, one: DataFrame, on: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, whose keys are unique; ``counts`` (the keys and n) says how many rows of ``many`` a key has.

    A key with more than ``KEY_ROWS`` rows is hot: its row of ``one`` is copied to so many tasks as its rows fill, and its rows
    are dealt among them by a hash of their other columns.
    """
    hot = counts.filter(F.col("n") > KEY_ROWS).select(*on, F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("salts_"))
    if hot.isEmpty():
        return many.join(one, on, how)
    hot = written(hot, "hot-keys")
    hot = F.broadcast(hot) if hot.count() <= MOST_HOT else hot
    rest = [c for c in many.columns if c not in on]
    dealt = many.join(hot, on, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(*rest), F.col("salts_")).cast("int"), F.lit(0))).drop("salts_")
    copies = one.join(hot, on, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce("salts_", F.lit(1)) - 1))).drop("salts_")
    return dealt.join(copies, [*on, "salt_"], how).drop("salt_")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs with low <= point <= high (and equal ``by`` columns): both sides meet in bins of ``width``, a range in each bin that it
    touches, so the join is an equality of bins. Rows with a null in these columns find no partner."""
    by = by or []
    bin_of = lambda c: F.floor(F.col(c) / width)
    left = points.withColumn("bin_", bin_of(point))
    right = ranges.filter(F.col(low) <= F.col(high)).withColumn("bin_", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return left.join(right, [*by, "bin_"]).filter((F.col(low) <= F.col(point)) & (F.col(point) <= F.col(high))).drop("bin_")


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], bucket: Column | None = None) -> DataFrame:
    """``left`` with the columns of the latest row of ``right`` of the same ``by`` at or before its time; nulls where there is none.

    Time is cut into buckets (days, unless ``bucket`` says otherwise, as an expression of the column ``t_``). Within a bucket a
    window carries the last row on; what a bucket starts with comes from a window over one row a bucket. So a key with very
    many rows is spread over as many tasks as it has buckets. Of rows of ``right`` with equal times the largest counts.
    """
    bucket = F.to_date("t_") if bucket is None else bucket
    names = [c for c in right.columns if c not in by]
    l = left.select(*by, F.col(left_time).alias("t_"), F.struct(*left.columns).alias("l_"), F.lit(1).alias("side_"), F.lit(None).cast(right.select(F.struct(*names)).schema[0].dataType).alias("r_"))  # noqa: E741
    r = right.filter(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("t_"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("l_"), F.lit(0).alias("side_"), F.struct(*names).alias("r_"))
    both = l.unionByName(r).withColumn("bucket_", bucket)
    last = both.groupBy(*by, "bucket_").agg(F.max_by("r_", F.when(F.col("r_").isNotNull(), F.struct("t_", "r_"))).alias("end_"))
    before = Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    start = last.select(*by, "bucket_", F.last("end_", True).over(before).alias("start_"))
    within = Window.partitionBy(*by, "bucket_").orderBy("t_", "side_", "r_").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found_", F.last("r_", True).over(within)).filter("side_ = 1")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "bucket_"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    out = found.alias("a").join(start.alias("b"), condition, "left").select("l_.*", F.coalesce("found_", "start_").alias("found_"))
    return out.select(*left.columns, *[F.col(f"found_.{c}").alias(c) for c in names])
