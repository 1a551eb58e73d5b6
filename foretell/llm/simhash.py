"""SimHash near-duplicates by pigeonring filtering.

A document's fingerprint has bit b set if over half of its word shingles have bit b set in their XXH64 hash. Documents
whose fingerprints differ in ``BUDGET`` bits or fewer are linked, and a group is what links reach.

The 64 bits are a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most t bits, then some segment starts a
chain round the ring in which, for each length l, the first l segments differ in at most l * t / SEGMENTS bits in all
(pigeonring principle). With t = 3 and eight segments of eight bits the budgets are 0, 0, 1, 1, 1, 2, 2, 3 bits. So the
first two segments of the chain are equal, and of the next three (24 bits, one difference) one half is equal: this gives
16 exact 28-bit keys a fingerprint, one of which any linked pair shares. Within a key, pairs are pruned by the chain's
budgets of growing length before the full Hamming check.

Only distinct fingerprints take part, so exact copies cost nothing. Of a key's members only a spanning forest of links
is emitted, never all pairs; a key with more than ``BLOCK`` members is dealt out as pairs of blocks, so that no task holds
a whole hot key, and none is skipped. Components of the links are found without the driver (see components.py).

Defined cases: a null or empty text has fingerprint zero and is linked like any other; fewer words than the shingle make
one shingle of them all; repeated rows share a fingerprint and so a group; rows with a null doc_id take part, but the
least doc_id of a group is taken over those that are known (null if none is). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, kept, map_rows, remove, scan_only, scope, spread_join, written
from .components import connected_components

SHINGLE, SEED = 3, 42
BUDGET, SEGMENTS, BITS = 3, 8, 8
#: Bits that the first l segments of a chain may differ in, for l = 1, 2, ...
BUDGETS = tuple(length * BUDGET // SEGMENTS for length in range(1, SEGMENTS + 1))
BLOCK = 2048
#: Members up to which a key's pairs are compared as plain numbers, and not as arrays; the test is the same.
FEW = 12


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; A-Z are lower-cased, words are runs without ASCII space characters."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    over = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo + size - 1 : hi + size - 1].tolist(), strict=True)], np.uint64)
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * over > n).astype(object)).sum()) if (2 * over > n).any() else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(df: DataFrame, name: str, size: int = SHINGLE) -> DataFrame:
    """``df`` with its fingerprint as a signed long in column ``name``; no shuffle."""
    at = df.columns.index("text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = pa.array([_signed(fingerprint(t.as_py(), size)) for t in b.column(at)], pa.int64())
        return pa.RecordBatch.from_arrays([*b.columns, prints], names=[*b.schema.names, name])

    from pyspark.sql.types import LongType, StructType

    return map_rows(df, f, StructType([*df.schema.fields]).add(name, LongType()))


def _rotated(x, start: int):
    """The ring, cut before segment ``start`` (a column or an array)."""
    k = start * BITS
    return x if k == 0 else ((x >> np.uint64(k)) | (x << np.uint64(64 - k)))


def ring_keys(fp: F.Column) -> F.Column:
    """The exact keys of a fingerprint: (rotation, half) in the upper bits, 16 + 12 bits of it below."""
    keys = []
    for i in range(SEGMENTS):
        k = i * BITS
        ring = fp if k == 0 else F.shiftrightunsigned(fp, k).bitwiseOR(F.shiftleft(fp, 64 - k))
        first = ring.bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            rest = F.shiftrightunsigned(ring, 16 + 12 * half).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(first, 12).bitwiseOR(rest).bitwiseOR(F.lit((2 * i + half) << 28)))
    return F.array(*keys)


def _linked(one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Positions of others within BUDGET bits of one: chains of growing length first, then the full check."""
    at = np.arange(len(others))
    x = _rotated(others ^ one, start)
    for length in range(3, SEGMENTS):
        good = np.bitwise_count(x & np.uint64((1 << (BITS * length)) - 1)) <= BUDGETS[length - 1]
        x, at = x[good], at[good]
        if not len(at):
            return at
    return at[np.bitwise_count(x) <= BUDGET]


def _chained(x: int, start: int) -> bool:
    """Whether two fingerprints that differ by x keep the budgets of the chain from ``start`` on, and the whole one."""
    k = start * BITS
    ring = (x >> k | x << (64 - k)) & ((1 << 64) - 1)
    return all((ring & ((1 << (BITS * length)) - 1)).bit_count() <= BUDGETS[length - 1] for length in range(3, SEGMENTS + 1))


def forest(prints: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that span each group of the members of one key."""
    n = len(prints)
    if n <= FEW:
        values = prints.tolist()
        root = list(range(n))
        out = []
        for j in range(1, n):
            for i in range(j):
                if root[i] != root[j] and _chained(values[i] ^ values[j], start):
                    old = root[j]
                    root = [root[i] if r == old else r for r in root]
                    out.append((values[i], values[j]))
        return out
    root, out = np.arange(n), []
    for j in range(1, n):
        near = _linked(prints[j], prints[:j], start)
        if len(near):
            roots, first = np.unique(root[near], return_index=True)
            for i in near[first]:
                out.append((int(prints[i]), int(prints[j])))
            # near ones of one group share a root already, so each root is joined once
            root[np.isin(root, roots)] = roots[0]
            root[j] = roots[0]
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, one, two, fp), sorted by the first three: one run at a time."""
    run, held = None, []

    def edges() -> list[tuple[int, int]]:
        prints = np.unique(np.concatenate(held)) if len(held) > 1 else np.unique(held[0])
        return forest(prints, (run[0] >> 28) // 2) if len(prints) > 1 else []

    def made(found: list) -> pa.RecordBatch:
        a = np.array(found, np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        prints = columns[3].view(np.uint64)
        cuts = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)) + 1
        out: list = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            key = (int(columns[0][lo]), int(columns[1][lo]), int(columns[2][lo]))
            if key != run and held:
                out += edges()
                held = []
            run = key
            held.append(prints[lo:hi].copy())
        if out:
            yield made(out)
    if held and (out := edges()):
        yield made(out)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough to connect each group."""
    keyed = written(prints.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key")), "ring-keys", "lz4")
    # A key's members are counted first (partial sums before the shuffle), so that keys of one member go no further.
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "shared-keys", "lz4")
    members = spread_join(keyed, shared.select("key", "blocks"), ["key"], shared).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    dealt = members.withColumn("other", F.explode(others)).select("key", F.least("block", "other").cast("int").alias("one"), F.greatest("block", "other").cast("int").alias("two"), "fp")
    found = dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(_forests, "a long, b long")
    out = written(found.distinct(), "links")
    remove(prints.sparkSession, keyed, shared)
    return out


def groups(prints: DataFrame, least: F.Column) -> tuple[DataFrame, DataFrame]:
    """(fp, group_least) for each distinct fingerprint of ``prints``, the aggregate ``least`` over the rows that its links reach; and
    (fp, n), its number of rows."""
    each = written(prints.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")), "prints")
    found = connected_components(links(each.select("fp")))
    rooted = each.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "root")
    # Only fingerprints with links meet in a second step.
    alone = rooted.filter("root is null").select("fp", F.col("least").alias("group_least"))
    linked = written(rooted.filter("root is not null"), "linked")
    per_group = linked.groupBy("root").agg(F.min("least").alias("group_least"), F.count("*").alias("n"))
    joined = spread_join(linked, per_group.drop("n"), ["root"], per_group.select("root", "n"))
    return alone.union(joined.select("fp", "group_least")), each.select("fp", "n")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of (doc_id, text); other columns are not read."""
    d = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    with scope(docs.sparkSession):
        at = written(with_fingerprint(d, "fp", size).select("doc_id", "fp"), "fingerprints")
        found, counts = groups(at, F.min("doc_id"))
        rows = spread_join(at, found, ["fp"], counts)
        return kept(rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("group_least").alias("component_id")), "near-duplicates")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the least doc_id stays (unknown ids last, then the first written)."""
    fp, uid = free_name(docs, "_fp"), free_name(docs, "_uid")
    read = docs if scan_only(docs) else kept(docs, "documents")
    with scope(docs.sparkSession):
        at = written(with_fingerprint(read.select("doc_id", "text"), fp, size).select("doc_id", fp).withColumn(uid, F.monotonically_increasing_id()), "with-fingerprints")
        found, _ = groups(at.select(F.col(fp).alias("fp"), "doc_id", F.col(uid).alias("uid")), F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("uid"))))
        stay = kept(found.select(F.col("group_least.uid").alias(uid)).distinct(), "stay")
    return read.withColumn(uid, F.monotonically_increasing_id()).join(stay, uid, "left_semi").select(*docs.columns)
