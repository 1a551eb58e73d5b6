"""Deterministic k-means that does not depend on the order of the rows.

Rows are standardised and sorted by their values; seeds are drawn along that order by a fixed generator (the first evenly,
the others by squared distance), then at most 100 rounds of assigning and averaging follow. Up to ``LOCAL_ROWS`` rows run
in one task, to the last bit as defined; more run as aggregations over all executors, with the same draws and steps, but for the
order in which a sum's terms are added (a row that lies between two centres to the last digits may fall to the other one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foretell.operators.predict import encoded
from foretell.operators.windows import vector_of
from foretell.plans.encode import EncodingError
from foretell.plans.ordinal import with_row_id

SEED = 0x9E3779B97F4A7C15  # fixed value
ROUNDS = 100
LOCAL_ROWS = 500_000
OVER_K = 3


def draws() -> Iterator[float]:
    """Numbers in [0, 1) of a 64-bit xorshift generator (13, 7, 17)."""
    x, full = SEED, (1 << 64) - 1
    while True:
        x ^= (x << 13) & full
        x ^= x >> 7
        x ^= (x << 17) & full
        yield (x >> 11) / (1 << 53)


def _distance2(z: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out = np.zeros(len(z))
    for j in range(z.shape[1]):  # column after column, so that sums run in a fixed order
        out += (z[:, j] - centre[j]) ** 2
    return out


def kmeans(z: np.ndarray, k: int) -> np.ndarray:
    """Labels of rows that are sorted already."""
    n, d = z.shape
    k, draw = min(max(k, 1), n), draws()
    centres = [z[int(next(draw) * n) % n]]
    nearest = _distance2(z, centres[0])
    while len(centres) < k:
        total = np.cumsum(nearest)[-1]
        if total <= 0:
            chosen = int(next(draw) * n) % n
        else:
            left = np.subtract.accumulate(np.concatenate(([next(draw) * total], nearest)))[1:]
            hit = np.flatnonzero(left <= 0)
            chosen = int(hit[0]) if len(hit) else n - 1
        centres.append(z[chosen])
        nearest = np.minimum(nearest, _distance2(z, centres[-1]))
    c, labels = np.array(centres), np.zeros(n, np.int64)
    for _ in range(ROUNDS):
        found = np.stack([_distance2(z, x) for x in c]).argmin(0)  # the lowest label on ties
        changed = (found != labels).any()
        labels = found
        sums, count = np.zeros((k, d)), np.bincount(labels, minlength=k)
        np.add.at(sums, labels, z)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        if not changed:
            break
    return labels


def labels_of(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of rows in any order: standardised, sorted by value (ties by place), clustered, and put back."""
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    total = np.cumsum(x, 0)[-1] / n
    sd = np.sqrt(np.cumsum((x - total) ** 2, 0)[-1] / n)
    sd[(sd == 0) | (x == x[0]).all(0)] = 1.0
    z = (x - total) / sd
    order = np.lexsort((np.arange(n), *z.T[::-1]))
    out = np.empty(n, np.int64)
    out[order] = kmeans(z[order], k)
    return out


def cluster(table, k: int, exclude: str | None = None, **options) -> DataFrame:
    """(row_id, cluster) of each row. ``exclude`` is no feature; vocabularies and means then come from rows where it is known."""
    if k < 1:
        raise EncodingError("k must be >= 1")
    e = encoded(table, exclude, **options)
    rows = e.df.select("row_id", "x")
    if e.n > LOCAL_ROWS:
        return _distributed(rows, e.n, e.n_features, min(k, e.n))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        return pd.DataFrame({"row_id": pdf.row_id, "cluster": labels_of(np.stack(pdf.x.to_list()), k)})

    return rows.groupBy().applyInPandas(one, "row_id long, cluster int")


def _distributed(rows: DataFrame, n: int, d: int, k: int) -> DataFrame:
    """The same steps as aggregations: sums of squared distances by stretch of the order, averages by label."""
    v = [F.col("x")[j] for j in range(d)]
    stats = rows.agg(*[F.avg(c).alias(f"m{j}") for j, c in enumerate(v)], *[F.stddev_pop(c).alias(f"s{j}") for j, c in enumerate(v)]).first()
    z = [((c - stats[f"m{j}"]) / (stats[f"s{j}"] or 1.0)).alias(f"z{j}") for j, c in enumerate(v)]
    names = [f"z{j}" for j in range(d)]
    at = with_row_id(rows.select("row_id", *z), [*names, "row_id"], "place").withColumn("stretch", (F.col("place") / 100_000).cast("long"))
    row = lambda i: [*at.filter(F.col("place") == i + 1).select(*names).first()]
    d2 = lambda c: sum(((F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(names, c, strict=True)), F.lit(0.0))
    draw = draws()
    centres = [row(int(next(draw) * n) % n)]
    while len(centres) < k:
        near = F.least(*[d2(c) for c in centres]) if len(centres) > 1 else d2(centres[0])
        sums = sorted(at.groupBy("stretch").agg(F.sum(near).alias("s")).collect(), key=lambda r: r["stretch"])
        total = sum(r["s"] for r in sums)
        if total <= 0:
            centres.append(row(int(next(draw) * n) % n))
            continue
        left, chosen = next(draw) * total, n - 1
        for r in sums:
            if left - r["s"] <= 0:
                run = F.sum("near").over(Window.orderBy("place"))  # one stretch of 100,000 rows
                hit = at.filter(F.col("stretch") == r["stretch"]).withColumn("near", near).withColumn("run", run).filter(F.col("run") >= left).agg(F.min("place")).first()[0]
                chosen = hit - 1 if hit is not None else n - 1
                break
            left -= r["s"]
        centres.append(row(chosen))
    label = lambda cs: F.array_position((a := F.array(*[d2(c) for c in cs])), F.array_min(a)) - 1
    for _ in range(ROUNDS):
        found = {r["label"]: [r[x] for x in names] for r in at.groupBy(label(centres).alias("label")).agg(*[F.avg(x).alias(x) for x in names]).collect()}
        after = [found.get(i, c) for i, c in enumerate(centres)]
        if after == centres:
            break
        centres = after
    return at.select("row_id", label(centres).cast("int").alias("cluster"))


def cluster_over(df: DataFrame, vector: list[str] | str, partition_by: list[str], name: str = "cluster", k: int = OVER_K) -> DataFrame:
    """``df`` with the cluster of each row within its window partition, by numeric columns or one array column.

    A partition is clustered as a whole, by one task, as its definition asks; what is wrong with a vector is an error (windows.py).
    """
    schema = T.StructType([*df.schema.fields]).add(name, T.IntegerType())
    rows = df.withColumn("__v", vector_of(vector))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len({len(v) for v in pdf["__v"]}) != 1:
            raise ValueError("feature vectors of one partition need one length")
        x = np.stack(pdf["__v"].to_list()).astype(float)
        return pdf.drop(columns="__v").assign(**{name: labels_of(x, k).astype("int32")})

    return rows.groupBy(*partition_by).applyInPandas(one, schema)
