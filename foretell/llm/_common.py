"""Arrow helpers and ways back to a table's partitions that the operators of this folder have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretell.plans.joins import spread_join  # noqa: F401
from foretell.sources.shared import filesystem, kept, kept_path, new_path, parquet_batches, remove, scope, shared_dir, written  # noqa: F401


def n_tasks(df: DataFrame, size: int) -> int:
    """Tasks for a table if each is meant to take ``size`` bytes, by the planner's estimate; the session's partitions at least."""
    spark = df.sparkSession
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-estimate // size), 1_000_000))


def scan_only(df: DataFrame) -> bool:
    """True if the plan reads one table of files and projects or filters it: then its partitions, and the row numbers that
    ``monotonically_increasing_id`` gives, are the same each time, and the rows need not be written to be read again."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().strip().split("\n")
    return all(x.lstrip(" +-:").startswith(("Project", "Filter", "Relation")) for x in lines)


#: Rows of texts that go to a Python worker at a time, unless the session says fewer; a bound on memory only.
BATCH_ROWS = 2_000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts are many kilobytes: ten thousand at a time, Spark's default, would fill an executor's memory."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def map_rows(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from batch to batch."""
    small_batches(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(each, schema)


def batch(**columns) -> pa.RecordBatch:
    """A record batch of typed arrays."""
    return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def publish(store, tmp: str, path: str) -> None:
    """Give a finished file its name; one that an earlier attempt of the task has left there holds the same bytes and goes."""
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(tmp, path)


def by_part(df: DataFrame, name: str, parts: int, outlive: bool = False) -> str:
    """Write rows so that those of one partition (column part) of another table are in a folder of their own, by ``row``; the path."""
    path = (kept_path if outlive else new_path)(df.sparkSession, name)
    df.repartition(max(1, parts), "part").sortWithinPartitions("part", "row").write.option("compression", "zstd").partitionBy("part").parquet(path)
    return path


def read_part(path: str, part: int, columns: list[str]) -> pa.Table | None:
    """What :func:`by_part` wrote for one partition, in order of ``row``; None if there is nothing."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = filesystem(path)
    folder = f"{root}/part={part}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    files = sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(store.open_input_file(x), columns=columns) for x in files]).sort_by("row") if files else None


def _listed(df: DataFrame, uids: DataFrame, uid: str, outlive: bool, pick, schema) -> DataFrame:
    """``pick(batch, marks)`` of each batch, marks telling which rows have one of these ``monotonically_increasing_id``s. The ids go
    back to the partitions of ``df`` (a plan that is :func:`scan_only`), so no row of ``df`` is shuffled."""
    small_batches(df.sparkSession)
    at = uids.select(F.shiftright(uid, 33).cast("int").alias("part"), F.col(uid).bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    path = by_part(at, "rows", df.rdd.getNumPartitions(), outlive)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        found = read_part(path, part, ["row"])
        rows, first, seen = found.column("row").to_numpy() if found is not None else np.zeros(0, np.int64), 0, 0
        for b in batches:
            lo, hi = np.searchsorted(rows, (first, first + b.num_rows)).tolist()
            marks = np.zeros(b.num_rows, bool)
            marks[rows[lo:hi] - first] = True
            yield from pick(b, marks, (part << 33) + first)
            first, seen = first + b.num_rows, seen + hi - lo
        if seen < len(rows):
            raise ValueError("the rows were not read in the same partitions again")

    return df.mapInArrow(f, schema)


def without_rows(df: DataFrame, uids: DataFrame, uid: str) -> DataFrame:
    """``df`` without the rows of these ids; the list outlives the present scope."""

    def pick(b, marks, first):
        yield b.filter(pa.array(~marks)) if marks.any() else b

    return _listed(df, uids, uid, True, pick, df.schema)


def rows_of(df: DataFrame, uids: DataFrame, uid: str) -> DataFrame:
    """The rows of these ids, with their id in column ``uid`` in front."""

    def pick(b, marks, first):
        if marks.any():
            some = b.filter(pa.array(marks))
            yield pa.RecordBatch.from_arrays([pa.array(first + np.flatnonzero(marks)), *some.columns], names=[uid, *some.schema.names])

    return _listed(df, uids, uid, False, pick, T.StructType([T.StructField(uid, T.LongType()), *df.schema.fields]))


def partition_offsets(spark: SparkSession, counts: list[tuple[int, int]]) -> dict[int, int]:
    """Start of each partition from (partition, count); one entry per partition, not per row."""
    out, total = {}, 0
    for p, n in sorted(counts):
        out[p], total = total, total + n
    return out


WORD = r"[^\x20\x09-\x0D]+"


def n_words(c) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a string column, by DataFrame functions; null: 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
