"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A data file is a run of records, each framed as

    length (8 bytes) | masked CRC-32 of those 8 bytes (4) | payload | masked CRC-32 of the payload (4)

all little-endian; the mask is ``rotate_right(crc, 15) + 0xa282ead8``, so that a checksum over data that holds checksums
stays sound. A payload is ``flags (1) | doc_id (8) | ids``, ids as unsigned 16-bit numbers if the vocabulary allows, else
32-bit. The index beside it holds one 28-byte entry a record: doc_id (8), byte offset (8), ids of all records before it
in this file (8), number of ids (4). A reader that shuffles seeks by the index; nothing needs the records in order.

Documents are dealt by ranges of doc_id, so that file after file they are in ascending order; a task streams its range
into one file under a temporary name and then renames it, so a task that runs again leaves the same bytes.

Defined cases: null text is an empty text (the end id alone); null doc_id sorts first and stays null; rows of one doc_id
are ordered by their text. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import filesystem, n_tasks, new_path, partition_offsets, publish, small_batches

END_ID = 2
MASK = 0xA282EAD8
ENTRY = "<qqqI"
#: Words whose ids a worker remembers anew before it forgets those not met since as many were new. A bound on memory only, the
#: ids are the same.
MEMO = 300_000
#: Bytes of input that one file is meant to hold.
FILE_BYTES = 128 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def frames(stream) -> Iterator[bytes]:
    """Payloads of a data file, one after the other; raises where a checksum or a length is wrong."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("damaged record length")
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
            raise ValueError("damaged record")
        yield body[:n]


#: Words of which normalising is plain lower-casing and whose parts this pattern finds; all others go through the library.
PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


#: The splitting rule for which PARTS stands; a file with another one is left to the library. A fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(free)) for b in range(256)}


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file that lower-cases and splits at white space, each distinct word being encoded once.

    Words are runs without ASCII space characters. The file's own rules treat these as boundaries, so the ids of a text
    are those of its words, one after the other. The merges are the library's; for words of ASCII and Latin-1 letters its
    slow general normaliser and splitter are left out (tests compare the ids with the library's on whole texts).
    """

    def __init__(self, text: str):
        """``text``: the content of the tokenizer's file."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        rules = json.loads(self.tokenizer.to_str())
        self.plain = [x["type"] for x in rules["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == SPLIT if rules["normalizer"] and "normalizers" in rules["normalizer"] else False
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.pack = {n: struct.Struct(f"<{n}{'H' if self.width == '<u2' else 'I'}").pack for n in range(1, 33)}
        # Each memory has a present and a former generation; what is met in the former one moves to the present one.
        self.memo: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.former_parts: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        pack = self.pack.get(len(ids))
        return pack(*ids) if pack else np.array(ids, self.width).tobytes()

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) >= MEMO:
                self.parts, self.former_parts = {}, self.parts
            ids = self.former_parts.get(text)
            if ids is None:
                letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
                ids = self.packed([t.id for t in self.merge(letters)])
            self.parts[text] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain and text.isascii() and text.isalpha():
            return self.part(text.lower())
        if self.plain and PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.part, PARTS.findall(text.lower())))
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, texts: list[str | bytes | None], end: int = END_ID) -> list[bytes]:
        """Ids of each text, given as it is or in UTF-8, and the end id, as little-endian numbers."""
        split = [(t if isinstance(t, bytes) else (t or "").encode()).split() for t in texts]
        met = set().union(*split)
        new = met.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.former = {}, self.memo
            new = met
        for w in new:
            ids = self.former.get(w)
            self.memo[w] = self.word(w) if ids is None else ids
        last, get = np.array([end], self.width).tobytes(), self.memo.__getitem__
        return [b"".join(map(get, words)) + last for words in split]


#: Texts that are split into words at a time: so many, or so many bytes. Bounds on memory only.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def slices(docs: list, texts: list[bytes | None]) -> Iterator[tuple[list, list[bytes | None]]]:
    """Both lists in slices, each ending with the text that reaches a bound."""
    lo, size = 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t or b"")
        if size >= SLICE_BYTES or i - lo == SLICE_ROWS or i == len(texts):
            yield docs[lo:i], texts[lo:i]
            lo, size = i, 0


_encoders: dict[int, WordEncoder] = {}


def encoder(text: str) -> WordEncoder:
    """One encoder a worker and tokenizer."""
    key = hash(text)
    if key not in _encoders:
        _encoders[key] = WordEncoder(text)
    return _encoders[key]


def file_text(spark, path: str) -> str:
    """A small file's text, from a local path or any store that Spark reads."""
    if "://" not in path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    return spark.read.option("wholetext", True).text(path).first()[0]


def write_records(docs: DataFrame, tokenizer: str, path: str | None = None, files: int | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Write (doc_id, text) as record and index files below ``path``; return it and (file, records, ids) of each file.

    The tokenizer's file is read on the driver and sent to the tasks. ``files`` is set by the size of the input if not given.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "records")
    files = files or n_tasks(docs, FILE_BYTES)
    sent = spark.sparkContext.broadcast(file_text(spark, tokenizer))
    d = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = d.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx, (store, root) = TaskContext.get(), filesystem(path)
        part, n, ids, at = ctx.partitionId(), 0, 0, 0
        encode = encoder(sent.value)
        size = int(encode.width[-1])
        store.create_dir(root, recursive=True)
        tmp = f"{root}/_part-{part:06d}-{ctx.taskAttemptId()}"
        with store.open_output_stream(tmp + ".rec") as data, store.open_output_stream(tmp + ".idx") as index:
            for b in batches:
                for docs, texts in slices(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                    for doc, enc in zip(docs, encode(texts), strict=True):
                        record = frame(struct.pack("<Bq", (doc is None) | (size << 4), doc or 0) + enc)
                        data.write(record)
                        index.write(struct.pack(ENTRY, doc or 0, at, ids, len(enc) // size))
                        n, ids, at = n + 1, ids + len(enc) // size, at + len(record)
        if n:
            for kind in (".rec", ".idx"):
                publish(store, tmp + kind, f"{root}/part-{part:06d}{kind}")
        else:
            store.delete_file(tmp + ".rec")
            store.delete_file(tmp + ".idx")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n, ids)], names=["part", "n", "ids"])

    done = ranged.mapInArrow(write, "part long, n long, ids long").collect()
    return path, sorted((r.part, r.n, r.ids) for r in done if r.n)


def read_records(spark, path: str, written: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record, read from the files; starts run on from file to file."""
    if not written:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    base = partition_offsets(spark, [(p, ids) for p, _, ids in written])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        for b in batches:
            for part, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with store.open_input_stream(f"{root}/part-{part:06d}.rec") as data:
                    for body in frames(data):
                        flags, doc = struct.unpack("<Bq", body[:9])
                        ids = np.frombuffer(body, f"<u{flags >> 4}", offset=9)
                        rows.append((None if flags & 1 else doc, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        first += len(ids)
                        if len(rows) == 20_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    parts = spark.createDataFrame([(p, base[p]) for p, _, _ in written], "part long, first long").repartition(len(written))
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_at(path: str, part: int, positions: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of the records at these positions of a file, in this order, by the index alone: a shuffled read."""
    store, root = filesystem(path)
    with store.open_input_file(f"{root}/part-{part:06d}.idx") as index, store.open_input_file(f"{root}/part-{part:06d}.rec") as data:
        for p in positions:
            doc, at, _, _ = struct.unpack(ENTRY, index.read_at(struct.calcsize(ENTRY), p * struct.calcsize(ENTRY)))
            data.seek(at)
            body = next(frames(data))
            yield doc, np.frombuffer(body, f"<u{body[0] >> 4}", offset=9)
