"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document is cut into blocks of ``BLOCK_WORDS`` words at most. A source with a target of t words, of s it has, gives
each of its blocks floor(t / s) times, and once more the first blocks of its keyed permutation, up to t: its exact quota of
blocks. All quotas together are dealt to the output shards by a tree: a node with quotas (q1, q2, ...) and k shards gives
its left half a multivariate-hypergeometric draw of the blocks, and the rest to the right. So each shard holds a random,
exact share of the quotas, as if all taken blocks had been shuffled and cut. The shards take disjoint stretches of each
source's permuted blocks, and every shard is shuffled by itself.

A node's draw hangs on the seed and the node alone, so each task walks down the tree by itself, along the nodes that its own
stretch of blocks meets; no table of shards is made anywhere, and their number has no limit. Positions within a source come
from a range-partitioned sort with partition totals, so a source with a third of all rows is spread over as many partitions
as its rows fill. The driver holds the plan, a few numbers for each source (weights are stated by source, so they are a
driver's list by nature) and for each partition. All draws hang on a seed and on keyed hashes of (doc_id, block), so reruns
agree.

:func:`deal` gives the mixed blocks as spans (uid, doc_id, block, words, shard, place), laid out by shard and shuffled within
it; :func:`block_texts` cuts their texts; :func:`mix_documents` gives whole rows, documents being blocks.

Defined cases: a null source is a source, last in order; null or empty texts have size 0 and nothing is taken of them; rows
that repeat (one doc_id) are rows like any other, each with its own line in the result; a source of size 0 has target 0; an
empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import by_part, free_name, kept, n_words, read_part, scan_only, scope, small_batches, written

WEIGHTS, BUDGET, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_WORDS = 256
SEED = 20240601
#: Words that an output shard is meant to hold.
SHARD_WORDS = 4_000_000
#: numpy draws below this population; beyond it, a rejection sampler of the same law does.
NUMPY_LIMIT = 1_000_000_000


def targets(sizes: list[float], weights: list[float], budget: float = BUDGET, most: float = MOST) -> list[float]:
    """Words to take of each source: shares of budget * sum(sizes) by weight, none above most * its size; the excess is shared anew."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget * sum(sizes)
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def _log_rise(n: float, k: float) -> float:
    """log((n + k)! / n!) - k log n, without the loss of digits that two large logarithms would bring (Stirling's series)."""
    if k == 0:
        return 0.0
    return (n + k + 0.5) * math.log1p(k / n) - k + (1 / (n + k) - 1 / n) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """How many of ``draw`` items out of good + bad are good, for counts of any size.

    Large populations go by Stadlober's ratio of uniforms around the mode; the masses are compared through logarithms of
    ratios, which stay accurate where the factorials themselves are far beyond a double's digits.
    """
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draw)) if draw else 0
    least, most = max(0, draw - bad), min(draw, good)
    if least == most:
        return least
    if min(good, bad, draw, total - draw) < 100_000:  # a thin tail: few items of one kind, placed one by one
        return _thin(rng, good, bad, draw)
    mode = (draw + 1) * (good + 1) // (total + 2)
    mean = draw * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - draw) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    parts = (mode, good - mode, draw - mode, bad - draw + mode)
    ratio = math.log((parts[1] / parts[0]) * (parts[2] / parts[3]))
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if not least <= x <= most:
            continue
        k = x - mode
        if min(parts[0] + k, parts[1] - k, parts[2] - k, parts[3] + k) < 1:
            continue
        log_mass = k * ratio - _log_rise(parts[0], k) - _log_rise(parts[3], k) - _log_rise(parts[1], -k) - _log_rise(parts[2], -k)
        if 2 * math.log(u) <= log_mass:
            return x


def _thin(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """The same law where one of the four counts is small: its items are placed one after the other."""
    total = good + bad
    if draw > total - draw:  # what is left instead of what is drawn
        return good - hypergeometric(rng, good, bad, total - draw)
    if min(good, bad) < draw:
        few, other = (good, bad) if good <= bad else (bad, good)
        hit, left, room = 0, draw, few + other
        for _ in range(few):
            inside = rng.random() * room < left
            hit, left, room = hit + inside, left - inside, room - 1
        return hit if good <= bad else draw - hit
    hit, room, free = 0, total, good
    for _ in range(draw):
        inside = rng.random() * room < free
        hit, free, room = hit + inside, free - inside, room - 1
    return hit


class SplitTree:
    """Quotas of sources dealt to shards. A node is (first shard, end of shards); its draw has a generator of its own."""

    def __init__(self, quotas, shards: int, seed: int = SEED):
        self.quotas, self.shards, self.seed = np.asarray(quotas, np.int64), max(1, shards), seed
        self.memo: dict[tuple[int, int], np.ndarray] = {}

    def left(self, q: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Of a node's quotas, those of its left half."""
        if (lo, hi) not in self.memo:
            rng = np.random.default_rng([self.seed, lo, hi])
            total = int(q.sum())
            draw, out = total * ((lo + hi) // 2 - lo) // (hi - lo), np.zeros_like(q)
            for i in range(len(q)):  # marginals of the multivariate draw, one source after the other
                total -= int(q[i])
                out[i] = hypergeometric(rng, int(q[i]), total, draw)
                draw -= int(out[i])
            if len(self.memo) * len(q) > 4_000_000:
                self.memo.clear()
            self.memo[lo, hi] = out
        return self.memo[lo, hi]

    def shards_of(self, source: int, turns: np.ndarray) -> np.ndarray:
        """Shard of each of a source's places ``turns`` (ascending); only nodes that hold one of them are drawn."""
        out = np.zeros(len(turns), np.int64)
        todo = [(self.quotas, 0, self.shards, 0, 0, len(turns))]
        while todo:
            q, lo, hi, base, a, b = todo.pop()
            if a == b:
                continue
            if hi - lo == 1:
                out[a:b] = lo
                continue
            left = self.left(q, lo, hi)
            cut = a + int(np.searchsorted(turns[a:b], base + int(left[source])))
            mid = (lo + hi) // 2
            todo.append((left, lo, mid, base, a, cut))
            todo.append((q - left, mid, hi, base + int(left[source]), cut, b))
        return out


def sized(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, source, size) of each row, written once: everything below hangs on these row numbers."""
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sizes")


def keyed(*parts) -> F.Column:
    """A number below 16**15 from the seed and the parts; null counts as empty."""
    text = F.concat_ws("|", F.lit(str(SEED)), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _blocks(sizes: DataFrame, block_words: int | None) -> DataFrame:
    """Blocks with words: uid, doc_id, source, size, block, words, pos (their keyed order). Without block_words, a document is one block."""
    d = sizes.filter("size > 0")
    if block_words:
        d = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words))))
        words = F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words)
    else:
        d, words = d.withColumn("block", F.lit(0).cast("long")), F.col("size")
    return d.withColumn("words", words).withColumn("pos", keyed("doc_id", "block"))


def _ranked(blocks: DataFrame) -> DataFrame:
    """blocks in order of (source, pos), with part, and rank and words before within part and source; no source is gathered."""
    order = [F.col("source").asc_nulls_last(), F.col("pos")]
    ranged = blocks.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id", "block", "size", "uid").drop("pos")
    at = [ranged.columns.index(x) for x in ("source", "words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n, w = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            words = b.column(at[1]).to_numpy()
            rank, before = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for lo, hi, source in _stretches(b.column(at[0])):
                if (source,) != last:
                    last, n, w = (source,), 0, 0
                rank[lo:hi] = n + np.arange(hi - lo)
                before[lo:hi] = w + np.cumsum(words[lo:hi]) - words[lo:hi]
                n, w = n + hi - lo, w + int(words[lo:hi].sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(words), part, np.int32)), pa.array(rank), pa.array(before)], names=[*b.schema.names, "part", "rank", "before"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", part int, rank long, before long"
    return written(ranged.mapInArrow(run, schema), "blocks")


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, str | None]]:
    """(first, end, value) of each stretch of equal values."""
    codes = column.dictionary_encode(null_encoding="encode")
    c, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
    cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield lo, hi, names[c[lo]]


def plan(sizes: dict[str | None, int], weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> list[dict]:
    """Sources in order (by code point, null last) with size, weight and target."""
    found = sorted(sizes.items(), key=lambda r: (r[0] is None, r[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(found))]
    target = targets([n for _, n in found], weight, budget, most)
    return [{"no": i, "source": s, "size": n, "weight": w, "target": t} for i, ((s, n), w, t) in enumerate(zip(found, weight, target, strict=True))]


class Taken:
    """The ranked blocks and, for each partition and source, what lies before; with these a task knows how often a block is taken."""

    def __init__(self, sizes: DataFrame, block_words: int | None, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST):
        self.blocks = _ranked(_blocks(sizes, block_words))
        # A row for each pair of partition and source in it; as rows are sorted by source, partitions + sources rows at most.
        totals = sorted(self.blocks.groupBy("part", "source").agg(F.count("*").alias("n"), F.sum("words").alias("w")).collect(), key=lambda r: r["part"])
        size: dict[str | None, int] = {r["source"]: 0 for r in sizes.groupBy("source").count().collect()}
        blocks, starts = dict.fromkeys(size, 0), {}
        for r in totals:
            s = r["source"]
            starts[r["part"], s] = blocks[s], size[s]
            blocks[s] += r["n"]
            size[s] += int(r["w"])
        self.plan = plan(size, weights, budget, most)
        for x in self.plan:
            x["blocks"] = blocks[x["source"]]
            x["epochs"] = int(x["target"] // x["size"]) if x["size"] else 0
        by = {x["source"]: x for x in self.plan}
        self.sent = sizes.sparkSession.sparkContext.broadcast((starts, by))

    def map(self, f, schema: str) -> DataFrame:
        """``f(batch, rows, source, rank, times)`` over the stretches of one source in the written blocks."""
        sent, columns = self.sent, ["uid", "doc_id", "block", "words", "source", "part", "rank", "before"]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, by = sent.value
            for b in batches:
                words, rank, before, part = (b.column(columns.index(c)).to_numpy() for c in ("words", "rank", "before", "part"))
                for lo, hi, source in _stretches(b.column(4)):
                    x = by[source]
                    for p in np.unique(part[lo:hi]).tolist():
                        rows = lo + np.flatnonzero(part[lo:hi] == p)
                        n0, w0 = starts[p, source]
                        # Beyond the whole epochs, the blocks whose middle lies before the rest of the target are taken once more.
                        rest = x["target"] - x["epochs"] * x["size"]
                        more = (before[rows] + w0 + words[rows] / 2 <= rest) & (rest > 0)
                        if (out := f(b, rows, x, rank[rows] + n0, x["epochs"] + more.astype(np.int64))) is not None:
                            yield out

        return self.blocks.select(*columns).mapInArrow(each, schema)

    def quotas(self) -> list[int]:
        """How many blocks the mix takes of each source."""

        def f(b, rows, x, rank, times):
            return pa.RecordBatch.from_arrays([pa.array([x["no"]], pa.int32()), pa.array([int(times.sum())], pa.int64())], names=["no", "n"])

        found = {r["no"]: int(r["n"]) for r in self.map(f, "no int, n long").groupBy("no").agg(F.sum("n").alias("n")).collect()}
        return [found.get(x["no"], 0) for x in self.plan]


def deal(taken: Taken, shard_words: int | None = None) -> DataFrame:
    """A row for each time a block is taken: uid, doc_id, block, words, shard, and place, its random position in the shard."""
    shards = -(-int(sum(x["target"] for x in taken.plan)) // (shard_words or SHARD_WORDS))
    sent = taken.blocks.sparkSession.sparkContext.broadcast(SplitTree(taken.quotas(), shards))

    def f(b, rows, x, rank, times):
        tree, out = sent.value, []
        for time in range(int(times.max()) if len(times) else 0):
            again = times > time
            at, turn = rows[again], time * x["blocks"] + rank[again]
            order = np.argsort(turn, kind="stable")
            shard = np.empty(len(at), np.int64)
            shard[order] = tree.shards_of(x["no"], turn[order])
            out.append((at, np.full(len(at), time), shard))
        if not out:
            return None
        at, time, shard = (np.concatenate(c) for c in zip(*out, strict=True))
        same = b.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*(same.column(i) for i in range(4)), pa.array(time), pa.array(shard)], names=["uid", "doc_id", "block", "words", "time", "shard"])

    dealt = taken.map(f, "uid long, doc_id long, block long, words long, time long, shard long")
    return dealt.withColumn("place", F.xxhash64(F.lit(SEED), "shard", "doc_id", "block", "time")).drop("time")


def laid_out(dealt: DataFrame) -> DataFrame:
    """The spans of the mix, each shard's together and in their random order."""
    return dealt.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def block_texts(docs: DataFrame, dealt: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(shard, place, doc_id, block, text): the words of each dealt block, single-spaced. ``docs``: uid, text."""
    rows = dealt.join(docs.select("uid", "text"), "uid")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return rows.select("shard", "place", "doc_id", "block", F.array_join(F.slice(words, (F.col("block") * block_words + 1).cast("int"), block_words), " ").alias("text"))


def mixed(docs: DataFrame) -> DataFrame:
    """A line per row: doc_id, size, source_size and target of its source, and taken, its words in the dealt shards."""
    spark = docs.sparkSession
    with scope(spark):
        sizes = sized(docs.select("doc_id", "source", "text"))
        taken = Taken(sizes, BLOCK_WORDS)
        dealt = written(laid_out(deal(taken)), "shards")
        sums = dealt.groupBy("uid").agg(F.sum("words").alias("taken"))
        sent = spark.sparkContext.broadcast({x["source"]: (x["size"], float(x["target"])) for x in taken.plan})

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [sent.value[s] for s in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64()), b.column(4)], names=["doc_id", "size", "source_size", "target", "taken"])

        rows = sizes.join(sums, "uid", "left").select("uid", "doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        return kept(rows.mapInArrow(f, "doc_id long, size long, source_size long, target double, taken long"), "mixed")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, documents as whole blocks, each shard's rows together and shuffled.

    What is taken of each partition of ``docs`` goes back to it as (row, shard, place), so a text moves once, to its shard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs if scan_only(docs) else kept(docs, "to-mix")
    with scope(spark):
        sizes = sized(docs.select("doc_id", "source", "text"))
        dealt = deal(Taken(sizes, None))
        at = dealt.select(F.shiftright("uid", 33).cast("int").alias("part"), F.col("uid").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "doc_id", "shard", "place")
        path = by_part(at, "taken", docs.rdd.getNumPartitions(), outlive=True)
    shard, place = free_name(docs, "_shard"), free_name(docs, "_place")
    id_at = docs.columns.index("doc_id")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted = read_part(path, TaskContext.get().partitionId(), ["row", "doc_id", "shard", "place"])
        rows, first, seen = wanted.column("row").to_numpy() if wanted is not None else np.zeros(0, np.int64), 0, 0
        for b in batches:
            lo, hi = np.searchsorted(rows, (first, first + b.num_rows)).tolist()
            for a in range(lo, hi, 1024):  # copies of long texts: a few rows at a time
                some = wanted.slice(a, min(1024, hi - a))
                out = b.take(pa.array(rows[a : a + len(some)] - first))
                if out.column(id_at).cast(pa.int64()).to_pylist() != some.column("doc_id").to_pylist():
                    raise ValueError("the documents were not read in the same partitions again")
                yield pa.RecordBatch.from_arrays([*out.columns, some.column("shard").combine_chunks(), some.column("place").combine_chunks()], names=[*out.schema.names, shard, place])
            first, seen = first + b.num_rows, seen + hi - lo
        if seen < len(rows):
            raise ValueError("the documents were not read in the same partitions again")

    schema = T.StructType([*docs.schema.fields]).add(shard, T.LongType()).add(place, T.LongType())
    out = docs.mapInArrow(f, schema)
    return out.repartitionByRange(F.col(shard), F.col(place)).sortWithinPartitions(shard, place).select(*docs.columns)
