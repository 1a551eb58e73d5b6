"""Suffix-array deduplication: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

A suffix sort of all text moves many tuples for every byte. Here it is kept for what can repeat at all:

1. *Anchors.* Of the first ``REACH`` places of a window of LENGTH bytes, the one with the least hash of 16 bytes is its
   anchor, and the ``LENGTH - REACH + 1`` bytes from the anchor are its context. Equal windows have the same anchor at the
   same offset and equal contexts. Windows next to each other share anchors, so a document is a list of *runs* of windows
   with one anchor each; a run's string (its windows' union) has 200 to 327 bytes.
2. Contexts that occur once hold no repeated window: most text ends here. If all runs of a context have one string, all
   their windows repeat.
3. Otherwise the distinct strings of the context are suffix-sorted: strings are dealt out by context in shards of bounded
   size, and each shard is sorted by induction: the order of the leftmost S-suffixes by doubling names of pairs of names, then
   that of all suffixes. Tuples of suffix and common prefix pass through queues by first byte, which go to disk (the
   shared folder) beyond a bound. Windows that share LENGTH bytes with a neighbour repeat. A context with more than ``MANY`` distinct strings isn't sorted in one
   task: its windows are parted by their offsets and longer shared cores, in steps, and counted over all tasks.
4. The repeated windows go back to their documents, which are read again in the same partitions; no text is shuffled.

Strings are judged on the input. Hashes of 64 bits, keyed anew each run, are used in pairs (context and run, context and
window), so equality is decided on 128 bits, and inside a shard on the bytes. Documents are never cut; a long one is worked through in pieces
of ``PIECE`` windows, so memory is bounded by the text itself.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; repeated rows repeat each other's strings and
lose all; an empty table gives no rows; null doc_ids stay null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_part, filesystem, new_path, read_part, remove, scan_only, scope, small_batches, written

LENGTH, REACH, GRAM = 200, 128, 16
CONTEXT = LENGTH - REACH + 1
PIECE = 1 << 20
SHARD_BYTES, MANY = 1_500_000, 1_000
#: Widths of the classes of offsets by which the windows of a context with many strings are parted, in turn.
WIDTHS = (32, 8, 1)


def multipliers() -> np.ndarray:
    """Odd multipliers of the hashes, drawn anew for each run, so that no text can be made to collide with another."""
    return np.random.default_rng().integers(1 << 62, 1 << 63, 16, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    x = x * m[8]
    x ^= x >> np.uint64(31)
    x *= m[9]
    x ^= x >> np.uint64(29)
    return x


def _hashes(data: np.ndarray, m: np.ndarray) -> dict[int, np.ndarray]:
    """Hash of the 1, 2, 4, ... 128 bytes from each place on (of what there is of them)."""
    out = {1: _mixed(data.astype(np.uint64) * m[10] + m[11], m)}
    n = 1
    for k in range(7):
        h = out[n]
        d = h * m[k]
        d[: len(h) - n] += h[n:]
        d ^= d >> np.uint64(32)
        n *= 2
        out[n] = d
    return out


def _runs(data: np.ndarray, ends: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, count, offset of the anchor, context hash, string hash) of the runs of windows.

    ``ends``: for each place, the end of its document; a window lies within one document.
    """
    n = len(data)
    h = _hashes(data, m)
    place = np.arange(n, dtype=np.uint64)
    key = (_mixed(h[GRAM], m) & ~np.uint64((1 << 24) - 1)) | place
    step = 1
    while step < REACH:  # the least of the next REACH keys, by doubling
        key[: n - step] = np.minimum(key[: n - step], key[step:])
        step *= 2
    anchor = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    p = np.flatnonzero(np.arange(n) + LENGTH <= ends)
    if not len(p):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    a = anchor[p]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(p) != 1) | (ends[p[1:]] != ends[p[:-1]]))))
    start, count = p[head], np.diff(np.append(head, len(p)))
    a = a[head]
    context = _mixed(h[64][a] * m[12] + h[8][a + 64] * m[13] + h[1][a + CONTEXT - 1], m)
    size = count + LENGTH - 1
    string = h[128][start] * m[12] + h[128][start + (size - 128) // 2] * m[13] + h[128][start + size - 128] * m[14]
    string = _mixed(string + (size * 512 + a - start).astype(np.uint64) * m[15], m)
    return start, count, a - start, context.view(np.int64), string.view(np.int64)


# Induced sorting of a shard


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the last is S."""
    n = len(t)
    d = np.zeros(n, np.int16)
    d[:-1] = t[1:].astype(np.int16) - t[:-1]
    d[-1] = 1
    at = np.where(d != 0, np.arange(n), n)
    return d[np.minimum.accumulate(at[::-1])[::-1]] > 0


class Queues:
    """First-in-first-out queues of (suffix, common prefix) arrays by first value: the priority queues of the induction.

    Within a first value, tuples arrive in their final order, so a queue for each is a priority queue. Beyond ``most``
    numbers in memory, all queues are appended to files below ``folder`` and read back when their turn comes.
    """

    def __init__(self, size: int, folder: str | None = None, most: int = 50_000_000):
        self.held: list[list[np.ndarray]] = [[] for _ in range(size)]
        self.files: list[list[str]] = [[] for _ in range(size)]
        self.folder, self.most, self.n, self.spills = folder, most, 0, 0

    def put(self, key: int, pairs: np.ndarray) -> None:
        self.held[key].append(pairs)
        self.n += pairs.size
        if self.folder and self.n > self.most:
            store, root = filesystem(self.folder)
            store.create_dir(root, recursive=True)
            for k, parts in enumerate(self.held):
                if parts:
                    name = f"{root}/{self.spills}-{k}"
                    with store.open_output_stream(name) as f:
                        f.write(np.concatenate(parts, 1).astype("<i8").tobytes())
                    self.files[k].append(name)
                    self.held[k] = []
            self.n, self.spills = 0, self.spills + 1

    def take(self, key: int) -> np.ndarray:
        """All tuples of a key so far, in order; the queue is empty then."""
        parts = []
        if self.files[key]:
            store, _ = filesystem(self.folder)
            for name in self.files[key]:
                with store.open_input_stream(name) as f:
                    parts.append(np.frombuffer(f.read(), "<i8").reshape(2, -1))
                store.delete_file(name)
            self.files[key] = []
        parts += self.held[key]
        self.n -= sum(x.size for x in self.held[key])
        self.held[key] = []
        return np.concatenate(parts, 1) if parts else np.zeros((2, 0), np.int64)


class _Inducer:
    """Sends the predecessors of sorted suffixes to their queues, with the common prefix of neighbours in a queue.

    The prefix shared by two neighbours in a queue is one more than the least between their successors. ``least`` holds, by
    queue, the least common prefix that has passed since its last tuple.
    """

    def __init__(self, t: np.ndarray, small: np.ndarray, want_small: bool, queues: Queues, carry: bool):
        self.t, self.small, self.want, self.queues, self.carry = t, small, want_small, queues, carry
        self.least = np.full(int(t.max()) + 1, -1, np.int64)  # -1: an empty queue, whose first tuple shares nothing

    def send(self, places: np.ndarray, lcp: np.ndarray, aside: int = -1) -> np.ndarray:
        """Sorted suffixes and the prefix that each shares with the one before (all 0 if ``carry`` is off); returns the tuples of queue ``aside``."""
        none = np.zeros((2, 0), np.int64)
        if not len(places):
            return none
        at = np.flatnonzero(places > 0)
        at = at[self.small[places[at] - 1] == self.want]
        q = places[at] - 1
        by = self.t[q]
        order = np.argsort(by, kind="stable")
        at, q, by = at[order], q[order], by[order]
        head = np.concatenate(([True], by[1:] != by[:-1])) if len(by) else np.zeros(0, bool)
        shared = np.zeros(len(by), np.int64)
        if len(by) and self.carry:
            start = np.where(head, 0, np.concatenate(([0], at[:-1] + 1)))
            padded = np.append(lcp, 0)
            shared = np.minimum.reduceat(padded, np.stack((start, at + 1), 1).ravel())[::2]
            shared[head] = np.minimum(shared[head], self.least[by[head]])
            shared = shared + 1  # an empty queue's -1 gives 0
        if self.carry:
            later = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.iinfo(np.int64).max // 2)
            self.least = np.where(self.least >= 0, np.minimum(self.least, later[0]), -1)
            if len(by):
                last = np.append(head[1:], True)
                self.least[by[last]] = later[at[last] + 1]
        out = none
        if len(by):
            cuts = np.append(np.flatnonzero(head), len(by))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                pairs = np.stack((q[lo:hi], shared[lo:hi]))
                if by[lo] == aside:
                    out = pairs
                else:
                    self.queues.put(int(by[lo]), pairs)
        return out


def _induced(t: np.ndarray, small: np.ndarray, stars: np.ndarray, star_lcp: np.ndarray, folder: str | None = None, carry: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in the order that the leftmost S-suffixes induce, and the prefix that each shares with the one before."""
    n, sigma = len(t), int(t.max()) + 1
    ends = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    run = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1  # how often the first value repeats
    cut = np.searchsorted(t[stars], np.arange(sigma + 1))
    queues = Queues(sigma, folder)
    up = _Inducer(t, small, False, queues, carry)
    done: list[np.ndarray] = []
    for c in range(sigma):
        got, last = [], -1
        wave = queues.take(c)
        while wave.shape[1]:  # a wave induces the next one where a value repeats
            got.append(wave)
            last = int(wave[0, -1])
            wave = up.send(wave[0], wave[1], c)
        own, shared = stars[cut[c] : cut[c + 1]], star_lcp[cut[c] : cut[c + 1]].copy()
        if len(own):  # an L-suffix and an S-suffix share their run of one value and no more
            shared[0] = min(run[last], run[own[0]]) if last >= 0 else 0
            up.send(own, shared)
        done.append(np.concatenate(got, 1) if got else np.zeros((2, 0), np.int64))
    queues = Queues(sigma, folder)
    down = _Inducer(t, small, True, queues, carry)
    if small[-1]:
        queues.put(int(t[-1]), np.array([[n - 1], [0]]))
    places, shares = [], []
    for c in range(sigma - 1, -1, -1):  # from the largest down; a prefix is shared with the one that was sent before
        got, last = [], -1
        wave = queues.take(c)
        while wave.shape[1]:
            got.append(wave)
            last = int(wave[0, -1])
            wave = down.send(wave[0], wave[1], c)
        larger = done[c][0][::-1]
        if len(larger):
            # turned round, a suffix's shared prefix stands with its other neighbour
            shared = np.concatenate(([min(run[last], run[larger[0]]) if last >= 0 else 0], done[c][1][:0:-1]))
            got.append(np.stack((larger, shared)))
            down.send(larger, shared)
        for x in got:
            places.append(x[0])
            shares.append(x[1])
        done[c] = None
    order, lcp = np.concatenate(places)[::-1], np.concatenate(shares)[::-1]
    return order, np.concatenate(([0], lcp[:-1]))


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, up to ``depth``; four values of 16 bits are compared at a time.

    The end of ``t`` is unlike all else, so two suffixes differ before either runs out.
    """
    p = np.append(t, np.zeros(4, np.int64)).astype(np.uint64)
    four = p[:-4] | p[1:-3] << np.uint64(16) | p[2:-2] << np.uint64(32) | p[3:-1] << np.uint64(48)
    out, at = np.full(len(a), depth, np.int64), np.arange(len(a))
    for k in range(0, depth, 4):
        x = four[a[at] + k] ^ four[b[at] + k]
        odd = x != 0
        low = x[odd]
        out[at[odd]] = k + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 16
        at = at[~odd]
        if not len(at):
            break
    return np.minimum(out, depth)


def suffix_order(t: np.ndarray, depth: int = LENGTH, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``t`` in order of their first ``depth`` values at least, and the prefix that each shares with the one
    before: exact below ``depth``, and not below it where the true length is not."""
    t = np.append(t.astype(np.int64) + 1, 0)  # the end is smaller than all
    small = _types(t)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(stars) > 1:
        by = stars[np.argsort(t[stars], kind="stable")]
        first, _ = _induced(t, small, by, np.zeros(len(by), np.int64), folder, False)  # for the names no prefixes are needed
        number = np.full(len(t), -1, np.int64)
        number[stars] = np.arange(len(stars))
        ranked = first[number[first] >= 0]  # the substrings from star to star, in order
        size = np.diff(np.append(stars, len(t) - 1)) + 1
        lengths = size[number[ranked]]
        # neighbours with one name agree in length and in every value
        even = np.flatnonzero(lengths[1:] == lengths[:-1])
        same = np.zeros(len(ranked) - 1, bool)
        same[even] = _shared(t, ranked[even], ranked[even + 1], int(lengths.max())) >= lengths[even]
        rank = np.zeros(len(stars), np.int64)
        rank[number[ranked]] = np.concatenate(([0], np.cumsum(~same)))
        step = 1
        while rank.max() + 1 < len(rank) and step <= depth:  # names of pairs of names, doubled until they differ or reach the depth
            after = np.zeros(len(rank), np.int64)
            after[: max(0, len(rank) - step)] = rank[step:] + 1
            rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1]
            step *= 2
        stars = stars[np.argsort(rank, kind="stable")]
    lcp = np.concatenate(([0], _shared(t, stars[:-1], stars[1:], depth))) if len(stars) else np.zeros(0, np.int64)
    order, lcp = _induced(t, small, stars, lcp, folder)
    return order[1:], np.concatenate(([0], lcp[2:]))


def repeated_windows(strings: list[bytes], folder: str | None = None) -> list[np.ndarray]:
    """For each string, which of its windows equal another window of these strings."""
    sizes = np.array([len(s) for s in strings])
    t = np.zeros(int(sizes.sum()) + len(strings), np.int16)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    for b, s in zip(begin.tolist(), strings, strict=True):
        t[b : b + len(s)] = np.frombuffer(s, np.uint8)
        t[b : b + len(s)] += 1
    order, lcp = suffix_order(t, LENGTH, folder)
    end = np.repeat(begin + sizes, sizes + 1)
    whole = order + LENGTH <= end[order]  # suffixes that start a window
    # Suffixes that share LENGTH values stand together; a stretch of them with two windows or more repeats. As no
    # window holds a separator, a suffix that shares them with a window starts one itself.
    stretch = np.cumsum(lcp < LENGTH)
    many = np.bincount(stretch[whole], minlength=int(stretch[-1]) + 1 if len(stretch) else 0) > 1
    marks = np.zeros(len(t), bool)
    marks[order[whole & many[stretch]]] = True
    return [marks[b : b + max(0, n - LENGTH + 1)] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of each stretch of true marks."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


# Over the documents


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]


def _all_runs(docs: DataFrame) -> DataFrame:
    m = multipliers()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0

        def made(texts: list[bytes], first_row: int, shift: int = 0) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in texts])
            data = np.frombuffer(b"".join(texts), np.uint8)
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            start, count, offset, context, string = _runs(data, np.repeat(begin + sizes, sizes), m)
            own = np.searchsorted(begin + sizes, start, side="right")
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(start), part, np.int32), (first_row + own).astype(np.int32), (start - begin[own] + shift).astype(np.int64), count.astype(np.int16), offset.astype(np.int16), context, string)], names=["part", "row", "start", "count", "offset", "context", "string"])

        for b in batches:
            texts = _texts(b)
            lo = 0
            while lo < len(texts):
                if len(texts[lo]) > PIECE:  # a long text goes in pieces that overlap by a window
                    for at in range(0, len(texts[lo]) - LENGTH + 1, PIECE):
                        yield made([texts[lo][at : at + PIECE + LENGTH - 1]], row + lo, at)
                    lo += 1
                    continue
                hi, size = lo, 0
                while hi < len(texts) and len(texts[hi]) <= PIECE and (hi == lo or size + len(texts[hi]) <= PIECE):
                    size += len(texts[hi])
                    hi += 1
                if size >= LENGTH:
                    yield made(texts[lo:hi], row + lo)
                lo = hi
            row += b.num_rows

    return docs.mapInArrow(f, "part int, row int, start long, count short, offset short, context long, string long")


def _strings(docs: DataFrame, path: str) -> DataFrame:
    """The bytes of the runs written at ``path``."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted = read_part(path, TaskContext.get().partitionId(), ["row", "start", "count", "offset", "context", "string", "many"])
        if wanted is None:
            return
        rows, first = wanted.column("row").to_numpy(), 0
        for b in batches:
            lo, hi = np.searchsorted(rows, (first, first + b.num_rows))
            if hi > lo:
                texts, some = _texts(b), wanted.slice(lo, hi - lo)
                own = (some.column("row").to_numpy() - first).tolist()
                cut = [texts[i][s : s + n + LENGTH - 1] for i, s, n in zip(own, some.column("start").to_pylist(), some.column("count").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c).combine_chunks() for c in ("context", "string", "many", "offset")), pa.array(cut, pa.binary())], names=["context", "string", "many", "offset", "bytes"])
            first += b.num_rows

    return docs.mapInArrow(f, "context long, string long, many boolean, offset short, bytes binary")


def _sorted_shards(strings: DataFrame) -> DataFrame:
    """(context, string, first, n): the repeated windows of strings with few others in their context."""
    spill = new_path(strings.sparkSession, "queues")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys: list[tuple] = []
        held: list[bytes] = []
        size, last, folder = 0, None, f"{spill}/{TaskContext.get().taskAttemptId()}"

        def made() -> pa.RecordBatch | None:
            out: list[tuple] = []
            for (context, string), marks in zip(keys, repeated_windows(held, folder), strict=True):
                if marks.any():
                    for a, n in zip(*_spans(marks), strict=True):
                        out.append((context, string, int(a), int(n)))
            if not out:
                return None
            c = [*zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], names=["context", "string", "first", "n"])

        for b in batches:
            for context, string, bytes_ in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if size >= SHARD_BYTES and context != last:  # a shard ends where a context ends
                    if (out := made()) is not None:
                        yield out
                    keys, held, size = [], [], 0
                keys.append((context, string))
                held.append(bytes_)
                size, last = size + len(bytes_), context
        if held and (out := made()) is not None:
            yield out

    few = strings.filter("not many").select("context", "string", "bytes")
    return few.repartition("context").sortWithinPartitions("context", "string").mapInArrow(f, "context long, string long, first int, n int")


def _classes(rows: DataFrame, width: int) -> DataFrame:
    """Each row's windows by the offset of the anchor in them, ``width`` offsets a class: first window and number of them, and
    two hashes, of the core that all windows of the class share and of the whole that these windows cover."""
    most = rows.columns.index("offset"), rows.columns.index("bytes"), rows.columns.index("lo"), rows.columns.index("size")

    def digest(head: bytes, text: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(head + text, digest_size=8).digest(), "little", signed=True)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["context", "string", "offset", "bytes"]
        for b in batches:
            at, made = [], []
            for i, (a, text, lo, size) in enumerate(zip(*(b.column(j).to_pylist() for j in most), strict=True)):
                least = a - (len(text) - LENGTH)  # the offset in the last window; in the first it is a
                for low in range(lo, lo + size, width):
                    if low <= a and low + width > least:
                        top, bottom = min(a, low + width - 1), max(low, least)
                        first, n = a - top, top - bottom + 1
                        at.append(i)
                        core = digest(b"", text[a - low : a + LENGTH - (low + width - 1)])
                        made.append((low, width, core, digest(b"%d %d " % (top, n), text[first : first + n - 1 + LENGTH]), first, n))
            if at:
                same = [b.column(b.schema.get_field_index(n)).take(pa.array(at)) for n in names]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True))], names=[*names, "lo", "size", "core", "whole", "first", "n"])

    return rows.mapInArrow(f, "context long, string long, offset short, bytes binary, lo int, size int, core long, whole long, first int, n int")


def _refined_windows(strings: DataFrame) -> DataFrame:
    """The same for contexts with many strings. Windows are parted by the offset of their anchor, in ever narrower classes.

    Equal windows are of one class and share its core, 200 bytes less the class's width; a string whose core is alone in
    its class leaves it. Where two strings agree on all that their windows of a class cover, these all repeat, and one of
    the strings stands for them in the next step. At width one the whole is the window. All is counted over all tasks.
    """
    rows = strings.filter("many").select("context", "string", "offset", "bytes", F.lit(0).alias("lo"), F.lit(REACH).alias("size"))
    out = None
    for width in WIDTHS:
        each = written(_classes(rows, width), "classes")
        agreed = written(each.groupBy("context", "whole").agg(F.count("*").alias("times"), F.min("string").alias("one")).filter("times > 1").drop("times"), "wholes")
        shared = written(each.groupBy("context", "lo", "core").agg(F.count("*").alias("times")).filter("times > 1").drop("times"), "cores")
        found = written(each.join(agreed, ["context", "whole"], "left"), "classes")
        ranges = found.filter("one is not null").select("context", "string", "first", "n")
        out = ranges if out is None else out.unionByName(ranges)
        rows = found.filter("one is null or one = string").join(shared, ["context", "lo", "core"], "left_semi").select("context", "string", "offset", "bytes", "lo", "size")
    return out


def repeats(docs: DataFrame) -> str:
    """Write the repeated stretches of windows of (doc_id, text) by partition of ``docs``; the path."""
    spark = docs.sparkSession
    parts = docs.rdd.getNumPartitions()
    runs = written(_all_runs(docs), "runs")
    of = runs.groupBy("context").agg(F.count("*").alias("n"), F.min("string").alias("a"), F.max("string").alias("b")).filter("n > 1")
    # Written, so that the join has two plain shuffled sides and a hot context is split at run time.
    of = written(of.select("context", (F.col("a") != F.col("b")).alias("mixed")), "contexts")
    shared = written(runs.join(of, "context"), "shared-runs")
    remove(spark, runs, of)
    mixed = shared.filter("mixed")
    variants = mixed.groupBy("context", "string").agg(F.count("*").alias("times"), F.min(F.struct("part", "row", "start", "count", "offset")).alias("at"))
    variants = written(variants.select("context", "string", "times", "at.*"), "variants")
    many = written(variants.groupBy("context").agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select("context", F.lit(True).alias("many")), "many")
    parted = variants.join(many, "context", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    wanted = by_part(parted.select("part", "row", "start", "count", "offset", "context", "string", "many"), "wanted", parts)
    strings = written(_strings(docs, wanted), "strings")
    found = _sorted_shards(strings).unionByName(_refined_windows(strings))
    # A string that occurs twice repeats as a whole, whatever its neighbours say.
    whole = variants.filter("times > 1").select("context", "string", F.lit(0).alias("first"), F.col("count").cast("int").alias("n"))
    partly = found.join(variants.filter("times > 1").select("context", "string"), ["context", "string"], "left_anti")
    ranges = written(whole.unionByName(partly), "ranges")
    there = shared.filter("not mixed").select("part", "row", "start", F.col("count").cast("int").alias("n"))
    edges = mixed.join(ranges, ["context", "string"]).select("part", "row", (F.col("start") + F.col("first")).alias("start"), "n")
    path = by_part(there.unionByName(edges), "repeats", parts, outlive=True)
    remove(spark, shared, variants, wanted, strings, ranges)
    return path


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of (doc_id, text); other columns are not read.

    ``kept`` is the remaining bytes; without ``texts`` it is left out where it is made. The documents are read three times in the same partitions, which hold for a table
    read from files; anything else is written first.
    """
    d = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    small_batches(docs.sparkSession)
    if not scan_only(d):
        d = written(d, "documents")
    with scope(docs.sparkSession):
        path = repeats(d)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    names, types = [x.split()[0] for x in schema.split(", ")], [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spans = read_part(path, TaskContext.get().partitionId(), ["row", "start", "n"])
        rows = spans.column("row").to_numpy() if spans is not None else np.zeros(0, np.int64)
        starts, counts = (spans.column(c).to_numpy() for c in ("start", "n")) if spans is not None else (rows, rows)
        first, seen = 0, 0
        for b in batches:
            out = []
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), _texts(b), strict=True)):
                lo, hi = np.searchsorted(rows, (first + i, first + i + 1))
                removed = n_spans = 0
                kept = text
                if hi > lo:
                    ends = starts[lo:hi] + counts[lo:hi] + LENGTH - 1
                    if ends.max() > len(text):
                        raise ValueError("the documents were not read in the same partitions again")
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, starts[lo:hi], 1)
                    np.subtract.at(edge, ends, 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, n_spans = int(gone.sum()), len(_spans(gone)[0])
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    seen += hi - lo
                out.append((doc, len(text), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            first += b.num_rows
            c = [*zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=False)], names=names)
        if seen < len(rows):
            raise ValueError("the documents were not read in the same partitions again")

    return d.mapInArrow(f, schema)
