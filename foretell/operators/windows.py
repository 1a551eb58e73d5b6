"""Operators over window partitions: anomaly scores and clusters of each row within its partition.

Both read a feature vector from every row of the partition, whatever its order: one array column, or several numeric ones.
A null vector, an empty one, one with a null component, or vectors of unequal lengths are errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretell.functions.numbers import or_one
from foretell.plans.joins import spread_join


def vector_of(columns: list[str] | str) -> Column:
    """The feature vector, checked: raises where it is null, empty or holds a null."""
    if isinstance(columns, str):
        v = F.col(f"`{columns}`").cast("array<double>")
    else:
        v = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    bad = v.isNull() | (F.size(v) < 1) | F.exists(v, lambda x: x.isNull())
    return F.when(bad, F.raise_error(F.lit("every row needs a feature vector without nulls, of one component at least"))).otherwise(v)


def anomaly_over(df: DataFrame, columns: list[str] | str, partition_by: list[str] = (), name: str = "score") -> DataFrame:
    """``df`` with the root mean square of each row's z-scores within its partition, ``sqrt(sum(z * z) / d)``.

    The partitions' means and deviations are aggregated (a row a position, partition and task is shuffled), and come back by a
    join that spreads large partitions, or, for the whole table as one partition, as one row that is broadcast. So neither
    the table nor a large partition is gathered in a task.
    """
    by = list(partition_by)
    keys = [f"__by{i}" for i in range(len(by))]
    rows = df.withColumn("__v", vector_of(columns))
    # null partition keys are one partition: they are joined by an equal pair (is null, value)
    rows = rows.withColumns({k: F.struct(F.col(f"`{c}`").isNull().alias("n"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for k, c in zip(keys, by, strict=True)})
    each = rows.select(*keys, F.posexplode("__v").alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n"))
    stats = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m", or_one(F.col("s")).alias("s")))).alias("__st"), F.min("n").alias("least"), F.max("n").alias("n"))
    checked = F.when(F.col("least") != F.col("n"), F.raise_error(F.lit("feature vectors of one partition need one length"))).otherwise(F.col("__st"))
    stats = stats.select(*keys, checked.alias("__st"), "n")
    joined = spread_join(rows, stats.drop("n"), keys, stats.select(*keys, "n")) if by else rows.crossJoin(F.broadcast(stats.drop("n")))
    z = F.zip_with("__v", "__st", lambda x, s: (x - s["m"]) / s["s"])
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x)
    return joined.withColumn(name, F.sqrt(total / F.size("__v"))).select(*[F.col(f"`{c}`") for c in df.columns], name)
