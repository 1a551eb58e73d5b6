"""Row numbers without a single-partition window.

The rows are sorted by ranges and written to the shared folder with their partition and their place in it; a partition's
numbers start after the sum of the counts before it. Only one count a partition reaches the driver. What is numbered is
written, so callers pass narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.sources.shared import written


def with_row_id(df: DataFrame, order_by: list[str], name: str = "row_id") -> DataFrame:
    """``df``, written, with ``name`` = 1, 2, ... in the order of ``order_by`` (nulls last). Ties are settled by a hash of the whole row,
    so that only rows that are equal in every column are interchangeable."""
    tie = F.xxhash64(*df.columns)
    order = [*[F.col(f"`{c}`").asc_nulls_last() for c in order_by], tie]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = written(ranged.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    starts, at = [], 1
    for r in sorted(held.groupBy("__part").count().collect(), key=lambda r: r["__part"]):
        starts.append((r["__part"], at))
        at += r["count"]
    first = df.sparkSession.createDataFrame(starts, "__part int, __first long")  # a row a partition
    return held.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__place")).drop("__part", "__place", "__first")
