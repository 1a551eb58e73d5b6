"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit tables, exact reranking.

Vectors are brought to length one, so the largest inner product is the largest cosine. A vector is cut into sub-vectors
of two dimensions, each coded by one of 16 centres (four bits; two codes a byte). Centres and codes are fitted to a loss
that weighs the part of the residual along the vector ``ETA`` times as much as the rest, because that part changes the
scores of the queries near the vector. Codes are chosen by coordinate descent on the whole vector's loss, centres by
weighted least squares, in turn.

A query is a table of 16 scores for each sub-vector, held as 8-bit numbers; a scan adds table entries. The index is scanned
where it lies, in partitions of some ten thousand vectors: a task reads the queries from the shared folder, a stretch at a
time, and leaves, for each query, the k nearest of its own rows by exact cosines in double precision. Only these are shuffled.
So neither vectors nor codes move. Each query is scored against every row, a table entry for each two dimensions: in some 64
dimensions without clusters, lists of coarse centres would have to be probed in their majority to find nine of ten neighbours.

Which vectors of a partition are compared exactly: first the ``RERANK`` best by the codes, the k-th of which has cosine t, say.
Let a unit vector x have the code x' and the residual x - x' = g x + r with r across x. For a query y with x.y = s, the part of
y across x has length sqrt(1 - s^2), so x'.y >= (1 - g) s - |r| sqrt(1 - s^2), which rises with s >= 0. A vector
whose approximate score is below that bound at t (less the rounding of the tables) can't be nearer than t; all others are
compared too. So no neighbour is lost, and in a group of near copies, where t is near 1, the bound is tight.

Cosines are sums in order of the components, of vectors scaled by powers of two, so that neither the partitioning nor the
scaling changes a bit of them.

Copies: of equal vectors only the k + 1 with the least ids can be among the k nearest, so the rest are set aside first,
which loses nothing; the limit is put before the shuffle (a partial one in each task).

The codebooks are fitted on a bounded sample: the ``SAMPLE`` vectors with the least keyed hash of their id. All rows are
indexed. Defined cases: vectors that are null, zero or hold null or non-finite components take no part, and rows with a null id
neither; vectors of different lengths are never compared, so those of each length are searched by themselves; rows that repeat
an id are rows like any other, as queries and as candidates (a row is only kept from itself); ties go to the smaller id; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import kept, map_rows, parquet_batches, scope, written

ETA, SAMPLE, ROUNDS, CENTRES, WIDTH = 4.0, 20_000, 8, 16, 2
#: Rows of the index and queries that a task holds at a time; vectors compared first.
BLOCK, QUERIES, RERANK = 65_536, 4096, 200
SEED = 7


def _fit_codes(x: np.ndarray, centres: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
    """Codes (n, m) of unit vectors (n, m, w) by coordinate descent on |r|^2 + (ETA - 1) (r.x)^2."""
    n, m, _ = x.shape
    if codes is None:
        codes = np.stack([((x[:, j, None] - centres[j]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    r = x - centres[np.arange(m), codes]
    along = (r * x).sum((1, 2))
    for _ in range(sweeps):
        for j in range(m):
            rest = along - (r[:, j] * x[:, j]).sum(1)
            trial = x[:, j, None] - centres[j]  # (n, 16, w)
            inner = (trial * x[:, j, None]).sum(2)
            best = ((trial**2).sum(2) + (ETA - 1) * (rest[:, None] + inner) ** 2).argmin(1)
            codes[:, j] = best
            r[:, j] = trial[np.arange(n), best]
            along = rest + inner[np.arange(n), best]
    return codes


def fit(x: np.ndarray) -> np.ndarray:
    """Centres (m, 16, w) fitted to unit vectors (n, d)."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    m = -(-d // WIDTH)
    x = np.pad(x, ((0, 0), (0, m * WIDTH - d))).reshape(len(x), m, WIDTH)
    centres = np.stack([x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), j] for j in range(m)])
    codes = None
    for _ in range(ROUNDS):
        codes = _fit_codes(x, centres, codes, 1)
        r = x - centres[np.arange(m), codes]
        along = (r * x).sum((1, 2))
        for j in range(m):  # least squares of one sub-space's centres, the others held
            rest = along - (r[:, j] * x[:, j]).sum(1)
            for c in range(CENTRES):
                own = codes[:, j] == c
                if not own.any():
                    centres[j, c] = x[rng.integers(len(x)), j]
                    continue
                y, b = x[own, j], rest[own]
                outer = (ETA - 1) * y.T @ y
                left = own.sum() * np.eye(WIDTH) + outer
                right = y.sum(0) + (ETA - 1) * ((y**2).sum(1) + b) @ y
                centres[j, c] = np.linalg.solve(left, right)
            r[:, j] = x[:, j] - centres[j, codes[:, j]]
            along = rest + (r[:, j] * x[:, j]).sum(1)
    return centres


def encode(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Packed codes (n, m / 2) of unit vectors (n, d), two four-bit codes a byte."""
    m = len(centres)
    x = np.pad(x, ((0, 0), (0, m * WIDTH - x.shape[1]))).reshape(len(x), m, WIDTH)
    codes = _fit_codes(x, centres).astype(np.uint8)
    if m % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def residuals(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes of unit vectors, and of each residual the part along the vector and the length of the part across it."""
    packed = encode(x, centres)
    codes = np.stack((packed & 15, packed >> 4), 2).reshape(len(x), -1)[:, : len(centres)]
    r = x - centres[np.arange(len(centres)), codes].reshape(len(x), -1)[:, : x.shape[1]]
    along = (r * x).sum(1)
    return packed, along, np.sqrt(np.maximum(((r - along[:, None] * x) ** 2).sum(1), 0))


def scan_scaled(queries: np.ndarray, packed: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Approximate scores (queries, vectors) from 8-bit tables, as whole numbers, with each query's step and offset."""
    m = len(centres)
    q = np.pad(queries, ((0, 0), (0, m * WIDTH - queries.shape[1]))).reshape(len(queries), m, WIDTH)
    table = np.einsum("qmw,mcw->qmc", q, centres)
    low = table.min(2, keepdims=True)
    step = np.maximum((table - low).max((1, 2), keepdims=True) / 255, 1e-12)
    small = np.rint((table - low) / step).astype(np.uint8)
    # sums of m entries of 255 at most: 16 bits hold them up to m = 257, 32 bits far beyond any vector
    out = np.zeros((len(queries), len(packed)), np.uint16 if m <= 257 else np.uint32)
    for j in range(m):
        codes = packed[:, j // 2] & 15 if j % 2 == 0 else packed[:, j // 2] >> 4
        out += small[:, j][:, codes]
    return out, step[:, 0, 0], low.sum((1, 2))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, so that the largest component lies in [1/2, 1): no square overflows, no digit changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def in_order(products: np.ndarray) -> np.ndarray:
    """Sum of each row, from its first number to its last."""
    return np.cumsum(products, axis=1)[:, -1]


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Block:
    """Rows of the index in a task: uid, vec_id, scaled vectors with their lengths, codes and residuals."""

    def __init__(self, uid, ids, v, packed, along, across):
        self.uid, self.ids, self.v, self.packed, self.along, self.across = uid, ids, scaled(v), packed, along, across
        self.lengths = np.sqrt(in_order(self.v * self.v))

    def nearest(self, own: int, q: np.ndarray, length: float, approx: np.ndarray, slack: float, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the ``k`` nearest but the row ``own`` itself, exact; see the head of this file for the bound."""

        def best(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = in_order(self.v[at] * q) / (self.lengths[at] * length)
            top = np.lexsort((self.uid[at], self.ids[at], -s))[:k]
            return at[top], s[top]

        others = np.flatnonzero(self.uid != own)
        if len(others) <= first:
            return best(others)
        at, s = best(others[np.argpartition(approx[others], len(others) - first)[-first:]])
        # (1 - along) t - across sqrt(1 - t^2) rises with t from 0 on; below 0 nothing is ruled out
        t = min(1.0, s[-1])
        reach = (1 - self.along) * t - self.across * np.sqrt(1 - t * t) if t >= 0 else np.full(len(self.ids), -np.inf)
        return best(others[(approx >= reach - slack - 1e-9)[others] | (self.along[others] >= 1)])


def _usable() -> F.Column:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)


RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "query long, query_id long, uid long, vec_id long, score double"


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, rerank: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest of each query among the rows of (vec_id, embedding) but itself."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("q_", is_query).selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) v", "coalesce(q_, false) is_query")
    with scope(spark):
        rows = written(rows.filter("vec_id is not null").filter(_usable()).withColumn("uid", F.monotonically_increasing_id()), "vectors")
        parts = [_search(rows.filter(F.size("v") == r["d"]), r["d"], k, max(rerank or RERANK, k + 1)) for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
        if not parts:
            return spark.createDataFrame([], RESULT)
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid"))
        return kept(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")


def _search(rows: DataFrame, dim: int, k: int, rerank: int) -> DataFrame:
    """``FOUND``: the ``k`` nearest of each query in each partition of the index."""
    spark = rows.sparkSession
    # Of equal vectors the k + 1 least ids are enough: the query itself and k others.
    same = F.row_number().over(Window.partitionBy("hash", "v").orderBy("vec_id", "uid"))
    candidates = written(rows.withColumn("hash", F.xxhash64("v")).withColumn("same", same).filter(F.col("same") <= k + 1).select("uid", "vec_id", "v"), "candidates")
    sample = candidates.orderBy(F.xxhash64(F.lit(SEED), "vec_id", "uid"), "uid").limit(SAMPLE).select("v").toArrow()
    centres = fit(unit(np.asarray(sample.column("v").combine_chunks().flatten()).reshape(-1, dim)))

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        packed, along, across = residuals(unit(_vectors(b.column(2), dim)), centres)
        codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([*b.columns, codes, pa.array(along), pa.array(across)], names=["uid", "vec_id", "v", "code", "along", "across"])

    index = written(map_rows(candidates, code, "uid long, vec_id long, v array<double>, code binary, along double, across double"), "index")
    queries = written(rows.filter("is_query").select("uid", "vec_id", "v"), "queries")
    folder = queries._written_at

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= BLOCK:
                yield from scanned(held)
                held, size = [], 0
        if held:
            yield from scanned(held)

    def scanned(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        one = [t.column(i).combine_chunks() for i in range(6)]
        packed = np.stack([np.frombuffer(x, np.uint8) for x in one[3].to_pylist()])
        block = Block(one[0].to_numpy(), one[1].to_numpy(), _vectors(one[2], dim), packed, one[4].to_numpy(), one[5].to_numpy())
        for b in parquet_batches(folder, QUERIES):
            uid, ids, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), _vectors(b.column(2), dim)
            q = scaled(raw)
            lengths, units = np.sqrt(in_order(q * q)), unit(raw)
            out = []
            for lo in range(0, len(q), 64):
                whole, step, low = scan_scaled(units[lo : lo + 64], block.packed, centres)
                for i in range(lo, min(lo + 64, len(q))):
                    at, s = block.nearest(uid[i], q[i], lengths[i], whole[i - lo] * step[i - lo] + low[i - lo], step[i - lo] * len(centres) / 2, k, rerank)
                    out.append((np.full(len(at), uid[i]), np.full(len(at), ids[i]), block.uid[at], block.ids[at], s))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.rdd.getNumPartitions())
    return index.repartition(tasks, "uid").mapInArrow(near, FOUND)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dim)
