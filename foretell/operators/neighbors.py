"""Distances to the support: nearest rows, and how far a row is from what the model has seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foretell.models.kernel import block_rows, standardiser
from foretell.models.scoring import in_tasks, map_vectors
from foretell.plans.encode import Encoded, EncodingError
from foretell.sources.shared import parquet_batches, written


def _mean_of_nearest(z: np.ndarray, support: np.ndarray, k: int, same: np.ndarray | None = None) -> np.ndarray:
    """Mean distance to the k nearest support rows; ``same`` gives the support row that a row is itself, left out."""
    d2 = np.zeros((len(z), len(support)))
    for j in range(support.shape[1]):
        d2 += (z[:, j, None] - support[:, j]) ** 2
    if same is not None:
        d2[np.arange(len(z)), same] = np.inf
    return np.sqrt(np.sort(np.partition(d2, k - 1, axis=1)[:, :k], axis=1)).mean(1)


class OwnDistances:
    """Mean distance of support rows, given by their places (a column), to their k nearest others."""

    def __init__(self, z: np.ndarray, k: int):
        self.z, self.k = z, k

    def __call__(self, places: np.ndarray) -> np.ndarray:
        at = places[:, 0].astype(np.int64)
        some = block_rows(len(self.z))
        return np.concatenate([_mean_of_nearest(self.z[at[lo : lo + some]], self.z, self.k, at[lo : lo + some]) for lo in range(0, len(at), some)])


class Reference:
    """How far support rows lie from each other: the yardstick for trust."""

    def __init__(self, x: np.ndarray, spark: SparkSession | None = None, n: np.ndarray | None = None):
        """``spark``: a session whose executors compare large supports. ``n``: how many rows each row stands for, one if not given."""
        if (len(x) if n is None else n.sum()) < 2:
            raise EncodingError("need >= 2 labeled rows for a distance reference")
        self.mean, self.sd = standardiser(x, n)
        self.z = (x - self.mean) / self.sd
        self.k = int(min(max((len(x) if n is None else n.sum()) - 1, 1), 5))
        places = np.arange(len(x), dtype=float)[:, None]
        if n is not None:  # beside a row itself, no more than k equal ones can be among its k nearest
            copies = np.minimum(n, self.k + 1)
            self.z, places = np.repeat(self.z, copies, 0), (np.cumsum(copies) - copies).astype(float)[:, None]
        own = OwnDistances(self.z, self.k)
        found = in_tasks(spark, places, own, len(self.z)) if spark else own(places)
        self.mu, self.most = np.average(found, weights=n), found.max()
        self.sigma = max(np.sqrt(np.average((found - self.mu) ** 2, weights=n)), 1e-9)

    def trust(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(trust, ood): 1 - z / 2 between 0 and 1; out of distribution beyond the farthest support row or z > 2."""
        z = (x - self.mean) / self.sd
        some = block_rows(len(self.z))
        d = np.concatenate([_mean_of_nearest(z[lo : lo + some], self.z, self.k) for lo in range(0, len(z), some)]) if len(z) else np.zeros(0)
        score = (d - self.mu) / self.sigma
        return np.clip(1 - np.maximum(score / 2, 0), 0, 1), (d > self.most) | (score > 2)


def trust_of(e: Encoded, rows: DataFrame) -> DataFrame:
    """(row_id, trust, ood) of rows of an encoded table."""
    x, _, n = e.grouped()
    ref = Reference(x, rows.sparkSession, n)

    def f(x: np.ndarray) -> dict:
        trust, ood = ref.trust(x)
        return {"trust": trust, "ood": ood}

    return map_vectors(rows, f, "trust double, ood boolean", e.n_features)


def similar(support: DataFrame, queries: DataFrame, k: int, vector: str = "x", support_id: str = "id", query_id: str = "id") -> DataFrame:
    """(query_id, rank, support_id, distance): the k nearest support rows of each query.

    Vectors are standardised by the support's mean and population deviation (1 where it is 0); distance is Euclidean; ties go
    to the smaller id. The queries are a stated set, written to the shared folder; each task goes through them in blocks and
    leaves, for each query, the k nearest of its own support rows. Only these are shuffled. Vectors of other lengths than the
    statistics, and null ones, are errors.
    """
    spark = support.sparkSession
    schema = "query_id long, rank int, support_id long, distance double"
    if k <= 0:
        return spark.createDataFrame([], schema)
    s = support.select(F.col(support_id).cast("long").alias("support_id"), F.col(vector).cast("array<double>").alias("s"))
    # Statistics by position; every task sums its rows first, so one row a position and task is shuffled.
    stats = s.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")).orderBy("i").collect()
    mean, sd = np.array([r["m"] for r in stats]), np.array([r["sd"] or 1.0 for r in stats])
    asked = written(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q")), "queries")
    folder, d = asked._written_at, len(mean)

    def vectors(column: pa.Array) -> np.ndarray:
        return (np.asarray(column.flatten(), float).reshape(len(column), d) - mean) / sd

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, z = b.column(0).to_numpy(), vectors(b.column(1))
            for q in parquet_batches(folder, QUERY_BLOCK):
                own, x = q.column(0).to_numpy(), vectors(q.column(1))
                d2 = np.zeros((len(x), len(z)))
                for j in range(d):  # component after component, so that sums run in a fixed order
                    d2 += (x[:, j, None] - z[:, j]) ** 2
                n = min(k, len(z))
                limit = np.partition(d2, n - 1, axis=1)[:, n - 1 : n]
                row, at = np.nonzero(d2 <= limit)  # the n nearest and all that tie with the last of them
                order = np.lexsort((ids[at], d2[row, at], row))
                row, at = row[order], at[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < n
                row, at = row[first], at[first]
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[at]), pa.array(np.sqrt(d2[row, at]))], names=["query_id", "support_id", "distance"])

    found = s.mapInArrow(near, "query_id long, support_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "support_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "support_id", "distance")


#: Queries that a task compares with a batch of its rows at a time.
QUERY_BLOCK = 128
