"""Tables written on the way to a result, in the folder that driver and executors share.

A written table ends its lineage: a lost executor costs no work above it. Tables belong to a :func:`scope`, one folder that
is deleted when the scope ends; what the result is read from is placed one scope further out (:func:`kept_path`), or, where
there is none, in the session's folder, which is deleted when its file systems close.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_scopes: list[str] = []
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session of one machine gets a temporary folder; a cluster is refused, as
    each of its executors would write to a disk of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foretell-")
        sc.setCheckpointDir(found)
        fs, p = _path(spark, found)
        fs.deleteOnExit(p)
    found = found.rstrip("/")
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _root(spark: SparkSession) -> str:
    """The session's own folder, which goes when its file systems close."""
    path = f"{shared_dir(spark)}/foretell-{spark.sparkContext.applicationId}"
    if path not in _roots:
        fs, p = _path(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _roots.add(path)
    return path


def _fresh(spark: SparkSession, name: str, folder: str | None) -> str:
    return f"{folder or _root(spark)}/{name}-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the present scope; a job that runs again never meets the files of another."""
    return _fresh(spark, name, _scopes[-1] if _scopes else None)


def kept_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name that outlives the present scope."""
    return _fresh(spark, name, _scopes[-2] if len(_scopes) > 1 else None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Tables written inside are deleted at the end, whether it succeeds or not."""
    path = _fresh(spark, "run", _scopes[-1] if _scopes else None)
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.pop()
        remove(spark, path)


def _written(df: DataFrame, path: str, codec: str) -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the present scope and read it again."""
    return _written(df, new_path(df.sparkSession, name), codec)


def kept(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The same, but outliving the present scope: for what a result is read from."""
    return _written(df, kept_path(df.sparkSession, name), codec)


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_written_at", None)
        if path:
            fs, p = _path(spark, path)
            fs.delete(p, True)


def filesystem(uri: str):
    """(file system, path) of a URI, for Python workers; any store that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def parquet_batches(path: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, file after file, in batches: for workers that go through all of a table in the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = filesystem(path)
    for name in sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet")):
        with store.open_input_file(name) as f:
            yield from pq.ParquetFile(f).iter_batches(rows)
