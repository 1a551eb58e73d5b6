"""SentencePiece encoding and decoding: a unigram model by Viterbi over a double-array trie of pieces with log scores.

``Pieces`` reads a public SentencePiece model file. Its trie is a double array (base, check): from state s, byte b leads
to base[s] + b if check holds s there. For a batch of distinct segments all positions walk the trie at once, a byte a
step, as array operations; then the best path is found position by position over all segments together. A character
that no piece covers falls back to its UTF-8 bytes as byte pieces (or to the unknown piece where the model has none).

The model file's own rules hold: its normaliser (a table of replacements, compiled into another double array; extra white space;
the marker in front), which pieces are unused or user-defined, and whether unknown characters become bytes or, a run at a
time, the unknown piece. A file that asks for what is not done here (markers behind words, white space that is not escaped, a
denormaliser, pieces with a marker after another character) is refused.

White space: a space becomes the marker U+2581, and one marker is put in front of the text; decoding turns markers into
spaces and drops the first. A text is cut into segments before each marker that follows another character. No piece holds
a marker after another character, so a best path never crosses a cut, and equal segments are encoded once a worker.

Scores: a unigram file's own log scores; for a file that holds merge ranks instead (byte-pair models, whose scores are no
log probabilities) the log of Zipf's law at the piece's rank. They are held as whole numbers of 2**-20, so path sums are
exact; between equal sums the path whose last piece is longer wins.

Defined cases: null or empty text (and one of white space alone, where the model removes it) has no pieces and decodes to the empty text; a marker in the text itself cannot be told
from a space (as in SentencePiece) and decodes to one; texts of any length are processed whole; each row stands alone.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_rows

MARKER = "▁"
SCALE = 1 << 20
#: Added to the least score for a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Kinds of piece in a model file; fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Segments whose pieces a worker remembers; beyond, it starts anew. A bound on memory only.
MEMO = 400_000
SEGMENT = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, tag & 7, value


@dataclass
class Rules:
    """What a model file says beside its pieces: type (1 unigram, 2 byte pairs), replacements, and what is done to white space."""

    kind: int = 1
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True


def read_model(path: str) -> tuple[list[tuple[str, float, int]], Rules]:
    """The (piece, score, kind) of a model file, and its rules."""
    pieces, rules = [], Rules()
    with open(path, "rb") as f:
        data = f.read()
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append((piece, score, kind))
        elif number == 2:
            for n, _, v in _fields(value):
                if n == 3:
                    rules.kind = v
                elif n == 24 and v:
                    raise ValueError("a model that puts markers behind words is not supported")
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 2:
                    rules.charsmap = v
                elif n == 3:
                    rules.dummy_prefix = bool(v)
                elif n == 4:
                    rules.remove_extra = bool(v)
                elif n == 5 and not v:
                    raise ValueError("a model that does not escape white space is not supported")
        elif number == 5 and any(n == 2 and v for n, _, v in _fields(value)):
            raise ValueError("a model with a denormaliser is not supported")
    return pieces, rules


def replacements(charsmap: bytes) -> dict[str, str]:
    """The table of a compiled normaliser: a length, a double array of 32-bit units, and the new strings, each ended by a zero.

    A unit holds its label in the low byte, its offset from bit 10 on (times 256 if bit 9 is set), and in bit 8 whether a string
    ends there; the value then stands in the unit at the offset.
    """
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units, strings = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist(), charsmap[4 + size :]
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    out, todo = {}, [(offset(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        for byte in range(1, 256):
            child = at ^ byte
            if child < len(units) and units[child] & 0x800000FF == byte:
                below = child ^ offset(units[child])
                if units[child] >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    out[(key + bytes([byte])).decode()] = strings[start : strings.index(b"\0", start)].decode()
                todo.append((below, key + bytes([byte])))
    return out


class Normaliser:
    """Text as the model wants it: replaced, without extra white space, spaces as markers, a marker in front."""

    def __init__(self, rules: Rules, whole: list[str]):
        """``whole``: pieces that no replacement may touch."""
        self.rules, self.whole = rules, set(whole)
        self.new = replacements(rules.charsmap)
        first = "".join(sorted({k[0] for k in self.new} | {k[0] for k in whole}))
        self.starts = re.compile(f"[{re.escape(first)}]") if first else None
        self.longest = max(map(len, [*self.new, *whole]), default=0)

    def replaced(self, text: str) -> str:
        """The longest replacement at each place, but user-defined pieces first."""
        if self.starts is None or not self.starts.search(text):
            return text
        out, at = [], 0
        for m in self.starts.finditer(text):
            p = m.start()
            if p < at:
                continue
            keys = [text[p : p + n] for n in range(min(self.longest, len(text) - p), 0, -1)]
            key = next((k for k in keys if k in self.whole), None)
            new = key
            if key is None:
                key = next((k for k in keys if k in self.new), None)
                new = self.new[key] if key is not None else None
            if key is not None:
                out += [text[at:p], new]
                at = p + len(key)
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        text = self.replaced(text)
        if self.rules.remove_extra:
            text = re.sub("  +", " ", text.lstrip(" ")).rstrip(f" {MARKER}")
        if not text:
            return ""
        return MARKER * self.rules.dummy_prefix + text.replace(" ", MARKER)


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """log(1 / ((rank + 2) * H)) for ranks in order of the file's scores, H making the shares sum to one."""
    ranked = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: (-pieces[i][1], i))
    total = sum(1 / (r + 2) for r in range(len(ranked)))
    out = [0.0] * len(pieces)
    for r, i in enumerate(ranked):
        out[i] = -math.log((r + 2) * total)
    return out


class Trie:
    """A double-array trie of byte strings: base, check, and the value where a string ends (-1 if none does)."""

    def __init__(self, items: dict[bytes, int]):
        size = 1 << 16
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        keys = sorted(items)
        free = 257  # below it, no state is free, or none can be reached from base 1 on by every byte
        last = [0] * 17
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo]) == depth:
                value[state] = items[keys[lo]]
                lo += 1
            if lo == hi:
                continue
            cuts = [lo, *(i for i in range(lo + 1, hi) if keys[i][depth] != keys[i - 1][depth]), hi]
            bytes_ = np.array([keys[i][depth] for i in cuts[:-1]])
            while check[free] >= 0:
                free += 1
            kind = min(len(bytes_), 16)
            at = max(1, free - int(bytes_[0]), last[kind])
            while True:  # the first place where all children fit, a stretch of places at a time
                if at + 1024 >= size:
                    base, check, value = (np.concatenate((x, np.full(size, -1, np.int64))) for x in (base, check, value))
                    size *= 2
                fits = (check[np.arange(at, at + 256)[:, None] + bytes_] < 0).all(1)
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += 256
            if kind > 1:  # below this place, nodes with as many children seldom fit
                last[kind] = at
            base[state] = at
            check[at + bytes_] = state
            for byte, a, b in zip(bytes_.tolist(), cuts[:-1], cuts[1:], strict=True):
                todo.append((at + byte, a, b, depth + 1))
        used = int(np.flatnonzero(check >= 0).max()) + 257
        self.base, self.check, self.value = base[:used], np.concatenate((check, np.full(256, -1, np.int64)))[:used], value[:used]

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, values) of all strings found, by length; a walk ends at its segment's end."""
        state = np.zeros(len(starts), np.int64)
        length = 0
        while len(starts):
            inside = starts + length < ends
            starts, ends, state = starts[inside], ends[inside], state[inside]
            to = self.base[state] + data[starts + length]
            good = self.check[to] == state
            starts, ends, state = starts[good], ends[good], to[good]
            length += 1
            found = self.value[state] >= 0
            if found.any():
                yield length, starts[found], self.value[state[found]]


class Pieces:
    """A model: encode and decode."""

    def __init__(self, path: str):
        pieces, self.rules = read_model(path)
        scores = [p[1] for p in pieces] if self.rules.kind == 1 else zipf_scores(pieces)
        self.text = [p[0] for p in pieces]
        self.kind = [p[2] for p in pieces]
        self.unknown = self.kind.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        usable = {t.encode(): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k in (NORMAL, USER_DEFINED) and t}
        if any(MARKER in t.lstrip(MARKER) for t in (self.text[i] for i in usable.values())):
            raise ValueError("a piece holds the marker after another character: texts cannot be cut into segments")
        normal = [x for x, k in zip(scores, self.kind, strict=True) if k == NORMAL]
        least, most = min(normal, default=0.0), max(normal, default=0.0)
        # a user-defined piece is worth the best score for each of its bytes, so that it wins
        scores = [len(t.encode()) * most - 0.1 if k == USER_DEFINED else x for t, k, x in zip(self.text, self.kind, scores, strict=True)]
        self.normal_form = Normaliser(self.rules, [t for t, k in zip(self.text, self.kind, strict=True) if k == USER_DEFINED and t])
        self.score = np.round(np.array(scores) * SCALE).astype(np.int64)
        self.unknown_score = round((least - UNKNOWN_PENALTY) * SCALE)
        self.trie = Trie(usable)
        self.is_byte = np.array([k == BYTE for k in self.kind])
        self.memo: dict[str, np.ndarray] = {}

    def quick_decode(self, ids: np.ndarray) -> str:
        """decode(), at the speed of a join where there are no byte, control or unknown pieces."""
        if len(ids) and (self.is_byte[ids].any() or ids.min() <= self.unknown + 2):
            return self.decode(ids.tolist())
        text = "".join(map(self.text.__getitem__, ids.tolist())).replace(MARKER, " ")
        if self.rules.remove_extra:
            return self.decode(ids.tolist()) if text.startswith("  ") else text.removeprefix(" ")
        return text[1:] if self.rules.dummy_prefix else text

    def best(self, segments: list[str]) -> list[np.ndarray]:
        """Piece ids of each segment's best path."""
        raw = [s.encode() for s in segments]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        width = np.diff(np.append(heads, len(data)))
        end_of = np.repeat(begin + sizes, sizes)
        first_of = np.repeat(begin, sizes)
        # Arcs (start, end, score, id). A character that is no piece gets an arc of its own.
        found = list(self.trie.matches(data, heads, end_of[heads]))
        alone = np.ones(len(data), bool)
        width_at = np.zeros(len(data), np.int64)
        width_at[heads] = width
        for length, starts, _ in found:
            alone[starts[width_at[starts] == length]] = False
        odd = heads[alone[heads]]
        starts = np.concatenate([*(x[1] for x in found), odd])
        ids = np.concatenate([*(x[2] for x in found), np.full(len(odd), -1)])
        ends = starts + np.concatenate([*(np.full(len(x[1]), x[0]) for x in found), width_at[odd]])
        gain = np.where(ids >= 0, self.score[ids], self.unknown_score)
        # All segments go forward together: step k settles what ends k bytes after its segment's start.
        depth = ends - first_of[starts]
        order = np.lexsort((starts, ends, depth))  # of the arcs to one place the longest comes first
        starts, ends, ids, gain, depth = (a[order] for a in (starts, ends, ids, gain, depth))
        number = np.repeat(np.arange(len(raw)), sizes)
        best = np.full(len(data) + len(raw) + 1, np.iinfo(np.int64).min // 2)
        best[begin + np.arange(len(raw))] = 0  # a place per byte and one for each segment's end
        back = np.zeros(len(best), np.int64)
        cuts = np.flatnonzero(np.diff(depth)) + 1
        own = number[starts]
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(depth)], strict=True):
            to = ends[lo:hi] + own[lo:hi]
            total = best[starts[lo:hi] + own[lo:hi]] + gain[lo:hi]
            heads_ = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            top = np.maximum.reduceat(total, heads_)
            at_top = np.flatnonzero(total == np.repeat(top, np.diff(np.append(heads_, hi - lo))))
            winner = at_top[np.unique(to[at_top], return_index=True)[1]]  # the longest of the best
            best[to[winner]] = total[winner]
            back[to[winner]] = lo + winner
        # All segments go back together.
        at, seg, path = begin + sizes, np.arange(len(raw)), []
        while len(seg):
            arc = back[at + seg]
            path.append((seg, arc))
            at = starts[arc]
            open_ = at > begin[seg]
            at, seg = at[open_], seg[open_]
        segs = np.concatenate([p[0] for p in path])
        arcs = np.concatenate([p[1] for p in path])
        turn = np.concatenate([np.full(len(p[0]), -i) for i, p in enumerate(path)])
        order = np.lexsort((turn, segs))
        segs, arcs = segs[order], arcs[order]
        pieces, where = ids[arcs], np.searchsorted(segs, np.arange(len(raw) + 1))
        out = []
        for i in range(len(raw)):
            own_ids = pieces[where[i] : where[i + 1]]
            if len(own_ids) and own_ids.min() < 0:
                full: list[int] = []
                for a in arcs[where[i] : where[i + 1]].tolist():
                    if ids[a] >= 0:
                        full.append(int(ids[a]))
                    else:
                        full += [self.bytes[int(x)] for x in data[starts[a] : ends[a]]] if self.bytes else [self.unknown]
                own_ids = np.array(full)
            out.append(own_ids.astype(np.int32))
        return out

    def plain(self, text: str) -> str:
        """The text in its normal form, with spaces and without the marker in front: what decoding is to give."""
        return self.plain_form(self.normal_form(text))

    def plain_form(self, form: str) -> str:
        text = form.replace(MARKER, " ")
        return text.lstrip(" ") if self.rules.remove_extra else text[1:] if self.rules.dummy_prefix else text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.encode_forms([self.normal_form(t or "") for t in texts])

    def encode_forms(self, forms: list[str]) -> list[np.ndarray]:
        """Ids of texts in their normal form, which are cut before each marker that follows another character."""
        split = [SEGMENT.findall(t) for t in forms]
        new = {s for x in split for s in x}
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        missing = sorted(new.difference(self.memo), key=len)
        # Segments of like length go together, about 200,000 characters a time; a longer one goes alone.
        lo = 0
        while lo < len(missing):
            hi, size = lo, 0
            while hi < len(missing) and (hi == lo or size + len(missing[hi]) < 200_000):
                size += len(missing[hi])
                hi += 1
            self.memo.update(zip(missing[lo:hi], self.best(missing[lo:hi]), strict=True))
            lo = hi
        get, none = self.memo.__getitem__, np.zeros(0, np.int32)
        out = [np.concatenate([*map(get, x)]) if x else none for x in split]
        return out if self.bytes else [self.merged(x) for x in out]

    def merged(self, ids: np.ndarray) -> np.ndarray:
        """Without byte pieces, a run of unknown characters is one unknown piece."""
        unknown = ids == self.unknown
        return ids[~(unknown & np.append(False, unknown[:-1]))] if unknown.any() else ids

    def decode(self, ids) -> str:
        """The text of piece ids: byte pieces join to characters, markers become spaces, the marker in front goes (all in front
        go where the model removes extra white space)."""
        out, run = [], bytearray()
        front = self.rules.dummy_prefix or self.rules.remove_extra
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(int(self.text[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kind[i] != CONTROL:
                piece = self.text[i]
                if front and not any(out) and piece.startswith(MARKER):
                    piece, front = piece[1:], self.rules.remove_extra
                out.append(piece)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARKER, " ")


SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, ids array<int>, ids_crc32 long, round_trip boolean"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Ids of each row of (doc_id, text), how many are byte pieces, and if they decode to the text; a narrow pass.

    The trie is built once, on the driver; its size is that of the vocabulary file, so it is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        rows = []
        for lo in range(0, b.num_rows, 500):
            some = b.slice(lo, 500)
            forms = [m.normal_form(t or "") for t in some.column(1).to_pylist()]
            for doc, form, ids in zip(some.column(0).to_pylist(), forms, m.encode_forms(forms), strict=True):
                n_bytes = int(m.is_byte[ids].sum()) if len(ids) else 0
                rows.append((doc, len(ids), n_bytes, ids, zlib.crc32(ids.astype("<u4").tobytes()), m.quick_decode(ids) == m.plain_form(form)))
        offsets = np.concatenate(([0], np.cumsum([r[1] for r in rows]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[3] for r in rows])))
        columns = [*zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), lists, pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.bool_())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_rows(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), f, SCHEMA)
