"""Quality rules: compression bands over whole documents and fixed chunks, beside counts of words, symbols and repeats.

A text that zstandard shrinks too much says little (repetition); one that it hardly shrinks is no prose (encoded or
random data). How far prose shrinks depends on the length, so each length class has its own band. The whole document is
judged, and so is each chunk of ``CHUNK`` bytes, because a long document hides a repetitive or random part from its
overall ratio.

Defined cases: a null or empty text has no words and fails the base rule. Texts are processed whole; memory is bounded
by the largest single text. Repeated rows are judged one by one, alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_rows

#: (bytes below which the band holds, least ratio, largest ratio); the ratio is raw bytes / compressed bytes. Set around the
#: ratios of the documents that pass the base rule (46,689 of 51,282), by class: 0.85-1.28, 0.92-2.62, 1.20-3.60, 1.31-2.52,
#: 1.38-2.19, 1.65-2.45, 1.80-2.61, 1.95-2.84, 2.24-2.99; wider for long texts, as other prose may differ from these.
BANDS = ((100, 0.8, 2.0), (200, 0.92, 2.8), (300, 1.15, 3.8), (500, 1.25, 3.0), (1_000, 1.32, 3.0), (2_000, 1.45, 3.2), (4_000, 1.5, 3.4), (16_000, 1.6, 3.8), (float("inf"), 1.7, 4.0))
CHUNK = 4096
#: A document goes if more than this share of its chunks is out of band.
BAD_CHUNKS = 1 / 5
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: From this many words on, windows are compared as ranked numbers; below, as tuples. Both are exact.
LONG = 50_000

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def in_band(n_bytes: int, ratio: float) -> bool:
    least, most = next((lo, hi) for below, lo, hi in BANDS if n_bytes < below)
    return least <= ratio <= most


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n < LONG:
        windows = list(zip(*(words[i:] for i in range(window)), strict=False))
        if len(set(windows)) == n:
            return 0
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        marks = np.fromiter((w in twice for w in windows), bool, n)
    else:
        ids: dict = {}
        word = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        rank = word
        for i in range(1, window):  # rank of the window so far and the next word: exact, as both are below 2**31
            rank = np.unique((rank[: n + window - 1 - i] << 31) | word[i:], return_inverse=True)[1]
        marks = np.bincount(rank)[rank] > 1
    ends = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(ends, at, 1)
    np.subtract.at(ends, at + window, 1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def judge(text: str | None, compressor) -> tuple:
    """The row of ``SCHEMA`` after doc_id."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII spaces only
    n = len(words)
    repeats = repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    ratio = len(raw) / len(compressor.compress(raw)) if raw else 0.0
    chunks = bad = 0
    if len(raw) > CHUNK:
        for i in range(0, len(raw), CHUNK):
            part = raw[min(i, len(raw) - CHUNK) :][:CHUNK]  # the last one is whole too: a short rest has no telling ratio
            chunks += 1
            bad += not in_band(len(part), len(part) / len(compressor.compress(part)))
    kept = not failed and in_band(len(raw), ratio) and bad <= BAD_CHUNKS * chunks
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines(text), repeats, failed, ratio, chunks, bad, kept)


def _judged(texts: pa.Array) -> list[tuple]:
    import zstandard

    compressor = zstandard.ZstdCompressor(level=LEVEL)
    return [judge(t.as_py(), compressor) for t in texts]


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row of (doc_id, text); other columns are not read. One narrow pass, no shuffle."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = _judged(b.column(1))
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_rows(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), f, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns; the verdict is applied where it is made, without a join."""
    at = docs.columns.index("text")
    return map_rows(docs, lambda b: b.filter(pa.array([r[-1] for r in _judged(b.column(at))], pa.bool_())), docs.schema)
