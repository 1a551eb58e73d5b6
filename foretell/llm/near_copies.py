"""Near copies by exact Jaccard similarity: SimHash links first, then a lossless prefix filter for what SimHash misses.

Two documents are linked if their sets of ``SHINGLE``-word shingles have a Jaccard similarity of ``SIMILAR`` tenths or more;
a group is what links reach. At that similarity fingerprints differ in some 10 of 64 bits (up to 20), where no key of a
pigeonring is selective, so SimHash alone can't find all pairs. Three steps:

1. Copies (equal words) are one node, known by a 128-bit hash.
2. Pairs within ``simhash.BUDGET`` bits, and each document with the first of those that share a rare shingle. These contract
   large groups.
3. Prefix filter: with shingles in any fixed order, linked documents share one of their first n - ceil(0.8 n) + 1 shingles.
   Of the pairs that share one and that sizes and positions don't rule out, first the likeliest between each two groups is
   compared, which joins most of what belongs together, then all pairs that are still in different groups.

Before texts are moved, pairs are tried by parity maps: each shingle of a document flips one bit of its map, so two maps
differ in no more bits than the sets differ in shingles, and a pair whose maps differ in more than a ninth of both sizes can't be
linked. A map has some four bits a shingle, a power of two in all, and is folded (by exclusive or) to the size of a smaller one;
a sketch of 512 bits rules out most pairs within a task, so that a common shingle leaves no square of its documents.

The order is by frequency in a sample of the documents, rare ones first, then by hash; the sample sets what it costs, never
what is found. Each pair of steps 2 and 3 is compared by the shingles themselves, so a link is never a guess.

Defined cases: as in simhash.py; documents without words are copies of each other, fewer words than the shingle make one
shingle of them all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import kept, map_rows, remove, rows_of, scan_only, scope, small_batches, spread_join, without_rows, written
from .components import connected_components

SHINGLE, SIMILAR = 5, 8
#: 64-bit words of a sketch; sketches of maps that are smaller are not compared with others.
SKETCH = 8
#: One document in so many is counted for the order of shingles; those found so often are frequent, the most frequent are held.
EVERY, OFTEN, HELD = 8, 3, 200_000


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None) -> set[bytes]:
    w = _words(text)
    size = min(SHINGLE, len(w))
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()


def linked(a: set, b: set) -> bool:
    both = len(a & b)
    return 10 * both >= SIMILAR * (len(a) + len(b) - both)


def hashes(text: str | None) -> np.ndarray:
    """XXH64 of each shingle, in order of place."""
    import xxhash

    w = _words(text)
    if not w:
        return np.zeros(0, np.uint64)
    size, joined, hash_ = min(SHINGLE, len(w)), b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - size + 1
    return np.fromiter((hash_(joined[a:b], simhash.SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)


def parity_map(h: np.ndarray) -> np.ndarray:
    """Bit h modulo the size is set if an odd number of hashes falls on it; as 64-bit words, a power of two of them."""
    words = 1 << max(0, (4 * len(h) - 1).bit_length() - 6)
    flips = np.bincount((h % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(bool), bitorder="little").view(np.uint64)


def folded(m: np.ndarray, words: int) -> np.ndarray:
    """A map at a smaller size; one that is smaller already is filled up with zeros, which a larger map must not be compared with."""
    return np.bitwise_xor.reduce(m.reshape(-1, words), 0) if len(m) >= words else np.pad(m, (0, words - len(m)))


def maybe_linked(x: bytes, y: bytes, n: int) -> bool:
    """Whether two maps allow a link between sets of n shingles together: similarity s leaves a difference of n (1 - s) / (1 + s)."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(x), len(y))
    return (10 + SIMILAR) * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= (10 - SIMILAR) * n


def print_of(h: np.ndarray) -> int:
    over = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        over += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * over > len(h), bitorder="little").view(np.int64)[0])


def prefix(h: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(n * SIMILAR / 10) + 1 of n distinct hashes, rare ones first."""
    n = len(h)
    count = np.zeros(n, np.int64)
    if n and len(often):
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        count = np.where(often[at] == h, counts[at], 0)
    return h[np.lexsort((h, count))][: n + 1 + -n * SIMILAR // 10 if n else 0]


def _frequent(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(hashes(t.as_py())) for t in b.column(0)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["token"])

    some = base.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0).distinct()
    rows = map_rows(some, f, "token long").groupBy("token").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(HELD).collect()
    a = np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2)
    tokens = np.ascontiguousarray(a[:, 0]).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], a[order, 1]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those that have it in common with another row."""
    last, seen = None, False  # the last row waits for the next batch; seen: the row before it had the same token
    for b in batches:
        if not b.num_rows:
            continue
        b = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        token, n = b.column(0).to_numpy(), b.num_rows
        same = token[1:] == token[:-1]
        good = np.append(same, False) | np.insert(same, 0, seen)
        if good[:-1].any():
            yield b.slice(0, n - 1).filter(pa.array(good[:-1]))
        last, seen = b.slice(n - 1), bool(same[-1]) if n > 1 else seen
    if seen:
        yield last


def _possible(root: np.ndarray, n: np.ndarray, place: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Of others, those in another group than i that sizes and the places of the first common shingle don't rule out."""
    both = np.minimum(n[i] - place[i], n[others] - place[others])
    return others[(root[others] != root[i]) & (10 * both >= SIMILAR * (n[i] + n[others] - both))]


def _pairs(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    """Rows (token, one, two, block, uid, root, n, place, sketch), sorted by the first three: (a, b, one, two, apart), the pairs of each
    run that need a comparison, with their groups and how far their sketches are apart; or (``best``) the nearest of two groups."""
    run, held = None, []

    def made() -> Iterator[pa.RecordBatch]:
        block, uid, root, n, place, sketch = (np.concatenate(c) for c in zip(*held, strict=True))
        if len(uid) < 2 or (root == root[0]).all():
            return
        inside, found, size = run[1] == run[2], [], 0
        whole = 4 * n > 64 * (SKETCH >> 1)  # the map is at least as large as the sketch
        right = np.flatnonzero(block == run[2])
        for x, i in enumerate(right if inside else np.flatnonzero(block == run[1])):
            near = _possible(root, n, place, i, right[:x] if inside else right)
            both = n[near] + n[i]
            apart = np.where(whole[near] & whole[i], np.bitwise_count(sketch[near] ^ sketch[i]).sum(1, dtype=np.int64) * (10 + SIMILAR) / both, 10 - SIMILAR)
            good = apart <= 10 - SIMILAR
            near, apart = near[good], apart[good]
            ends = (np.full(len(near), uid[i]), uid[near]), (np.full(len(near), root[i]), root[near])
            found.append((*(f(*e) for e in ends for f in (np.minimum, np.maximum)), apart))
            size += len(near)
            if size >= 100_000:
                yield links(found)
                found, size = [], 0
        if size:
            yield links(found)

    def links(found: list) -> pa.RecordBatch:
        a, b, one, two, apart = (np.concatenate(c) for c in zip(*found, strict=True))
        if best:
            order = np.lexsort((b, a, apart, two, one))
            first = order[np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))]
            a, b, one, two, apart = (c[first] for c in (a, b, one, two, apart))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, one, two, apart)], names=["a", "b", "one", "two", "apart"])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = [batch.column(i).to_numpy() for i in range(8)]
        sketches = np.asarray(batch.column(8).flatten()).view(np.uint64).reshape(-1, SKETCH)
        cuts = np.flatnonzero((np.diff(c[0]) != 0) | (np.diff(c[1]) != 0) | (np.diff(c[2]) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = (int(c[0][lo]), int(c[1][lo]), int(c[2][lo]))
            if key != run and held:
                yield from made()
                held = []
            run = key
            held.append([*(x[lo:hi].copy() for x in c[3:]), sketches[lo:hi].copy()])
    if held:
        yield from made()


def _confirmed(pairs: DataFrame, docs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose documents are linked: first tried by their maps, then compared by their shingles."""
    pairs = pairs.filter("a != b").distinct()
    one = maps.select(F.col("uid").alias("a"), F.col("n").alias("m"), F.col("map").alias("x"))
    two = maps.select(F.col("uid").alias("b"), "n", F.col("map").alias("y"))

    def tried(b: pa.RecordBatch) -> pa.RecordBatch:
        good = [maybe_linked(x, y, m + n) for m, x, n, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        return b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    near = written(map_rows(pairs.join(two, "b").join(one, "a").select("a", "b", "m", "x", "n", "y"), tried, "a long, b long"), "pairs")
    texts = written(rows_of(docs.select("text"), near.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "uid"), "compared")
    # The text of a stands before those of its partners; those of a common one are dealt to several tasks, each with its text.
    deal = F.pmod("b", F.lit(64)).alias("deal")
    firsts = near.select("a", deal).distinct().join(texts.withColumnRenamed("uid", "a"), "a").select("a", "deal", F.lit(None).cast("long").alias("b"), "text")
    others = near.select("a", deal, "b").join(texts.withColumnRenamed("uid", "b"), "b").select("a", "deal", "b", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, own = None, set()
        for batch in batches:
            out = []
            for x, b, text in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if not b.is_valid:
                    a, own = x.as_py(), shingles(text.as_py())
                elif linked(own, shingles(text.as_py())):
                    out.append((a, b.as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    both = firsts.unionByName(others).repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first())
    out = written(both.mapInArrow(compared, "a long, b long"), "near-copies")
    remove(docs.sparkSession, near, texts)
    return out


def _stars(grouped: DataFrame) -> DataFrame:
    """(a, b): each row with the first of those that share a token with it: of these, as far as sizes and places allow a link, the one
    that it meets at most tokens. A pair a row, however many have a token in common."""
    heads = grouped.groupBy("token").agg(F.min(F.struct("uid", "n", "place")).alias("head"), F.count("*").alias("members"))
    rows = spread_join(grouped, heads.select("token", "head"), ["token"], heads.select("token", F.col("members").alias("n")))
    both = F.least(F.col("n") - F.col("place"), F.col("head.n") - F.col("head.place"))
    may = (F.col("uid") != F.col("head.uid")) & (10 * both >= SIMILAR * (F.col("n") + F.col("head.n") - both))
    met = rows.filter(may).select("uid", F.col("head.uid").alias("head")).repartition("uid").groupBy("uid", "head").agg(F.count("*").alias("times"))
    best = met.groupBy("uid").agg(F.max_by("head", F.struct("times", -F.col("head"))).alias("head"))
    return best.select(F.least("uid", "head").alias("a"), F.greatest("uid", "head").alias("b"))


def _candidates(grouped: DataFrame, sketches: DataFrame, best: bool) -> DataFrame:
    """(a, b): pairs of rows (token, uid, n, place, root) of different groups to compare, or (``best``) of two groups the pair whose
    sketches are nearest; a token of many rows is dealt out as pairs of blocks."""
    open_ = grouped.groupBy("token").agg(F.count("*").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token", F.ceil(F.col("members") / simhash.BLOCK).cast("int").alias("blocks"), "members")
    open_ = written(open_, "open-tokens")
    rows = spread_join(grouped, open_.drop("members"), ["token"], open_.select("token", F.col("members").alias("n")))
    blocks = rows.join(sketches, "uid").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = blocks.select("token", F.least("block", "other").cast("int").alias("one"), F.greatest("block", "other").cast("int").alias("two"), "block", "uid", "root", "n", "place", "sketch")
    found = dealt.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two").mapInArrow(functools.partial(_pairs, best=best), "a long, b long, one long, two long, apart double")
    if best:
        found = found.groupBy("one", "two").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
    return found.select("a", "b")


def near_copies(docs: DataFrame) -> DataFrame:
    """(uid, root): the rows of ``docs`` (text; a plan that is scan_only), by their ``monotonically_increasing_id``, that are in a group of two or more."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"))
    held = spark.sparkContext.broadcast(_frequent(docs))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["uid", "copy", "fp", "n", "tokens", "map", "sketch"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some, rows = b.slice(lo, 1000), []
                for uid, t in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    t = t.as_py()
                    h = hashes(t)
                    own = np.unique(h)
                    m = parity_map(own)
                    rows.append((uid, xxhash.xxh3_128_digest(b" ".join(_words(t))), print_of(h), len(own), prefix(own, *held.value).view(np.int64), m.tobytes(), folded(m, SKETCH).view(np.int64)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    made = written(docs.select(F.monotonically_increasing_id().alias("uid"), "text").mapInArrow(f, "uid long, copy binary, fp long, n int, tokens array<long>, map binary, sketch array<long>"), "prefixes")
    copies = made.groupBy("copy").agg(F.min("uid").alias("node"), F.count("*").alias("n"))
    same = written(spread_join(made.select("uid", "copy"), copies.select("copy", "node"), ["copy"], copies.select("copy", "n")).select("uid", "node").filter("uid != node"), "copies")
    each, maps, sketches = made.join(same, "uid", "left_anti"), made.select("uid", "n", "map"), made.select("uid", "sketch")
    tokens = each.select("uid", "n", F.posexplode("tokens").alias("place", "token")).select("token", "uid", "n", "place")
    shared = written(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_shared, "token long, uid long, n int, place int"), "shared")

    prints = written(each.groupBy("fp").agg(F.min("uid").alias("least"), F.count("*").alias("n")), "prints")
    linked_prints = simhash.links(prints.select("fp"))
    ends = linked_prints.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    by_print = spread_join(each.select("uid", "fp"), prints.select("fp", "least"), ["fp"], prints.select("fp", "n")).select(F.col("least").alias("a"), F.col("uid").alias("b"))
    star = _stars(shared)
    edges = _confirmed(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(by_print).union(star), docs, maps)
    # First one pair for each two groups that may be linked, which joins most of them; then whatever is still apart.
    for best in (True, False):
        now = written(shared.join(connected_components(edges).withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")), "grouped")
        second = _confirmed(_candidates(now, sketches, best), docs, maps)
        edges = edges.union(second)
        remove(spark, now)
    return connected_components(edges.union(same.select(F.col("uid").alias("a"), F.col("node").alias("b")))).withColumnRenamed("node", "uid")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the least doc_id stays (unknown ids last, then the first written)."""
    read = docs if scan_only(docs) else kept(docs, "documents")
    with scope(docs.sparkSession):
        found = near_copies(read)
        ranked = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), "uid")
        grouped = written(read.select("doc_id", F.monotonically_increasing_id().alias("uid")).join(found, "uid"), "grouped")
        stay = grouped.groupBy("root").agg(F.min(ranked).getField("uid").alias("uid"))
        return without_rows(read, grouped.select("uid").join(stay, "uid", "left_anti"), "uid")
