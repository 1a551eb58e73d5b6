"""Content-addressed WARC archive: each distinct payload once, exact record headers apart, originals by a join.

``write_archive`` makes two kinds of file in one folder:

* ``payloads-*.warc.gz``: WARC 1.1 files, one gzip member a record. The *response* record of each distinct payload holds
  the payload; every other record of that payload is a *revisit* (identical-payload-digest) with an empty block. So the
  bytes are stored once, and any WARC reader can read the files.
* ``headers``: a table of the exact header bytes that each record would have with its payload beside it, with the digest
  under which the payload is stored.

Equality of payloads is equality of SHA-256 and length; readers compute both digests again from the stored bytes and
raise if one differs. ``restore`` joins headers and payloads on the digest to get each original record, byte for byte.

Which record of a digest is the response is decided on (digest, id) rows, and goes back to the partitions that the pages were
read in; payloads are shuffled once, in ``restore``, and there each distinct one.

Defined cases: null html is an empty payload; null url an empty target; of equal payloads the largest page_id is the
response, null page_ids being smallest and ties (repeated rows) going to the row written last. An empty table gives an
archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_part, filesystem, map_rows, new_path, publish, read_part, scan_only, scope, small_batches, spread_join, written

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads from this size on may be stored as revisits.
MIN_BYTES = 0


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(uid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{uid}')}>"


def header(kind: str, uid: int, page_id: int | None, url: str | None, sha1: str, sha256: str, length: int, refers_to: tuple | None = None) -> bytes:
    """Header block of a record, without the empty line that ends it. refers_to: (uid, page_id) of the response."""
    target = (url or "").encode("utf-8", "surrogatepass").replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: " + record_id(uid).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + sha1.encode(),
        b"X-Payload-SHA256: " + sha256.encode(),
        b"X-Page-ID: " + (b"" if page_id is None else str(page_id).encode()),
        b"X-Record: " + str(uid).encode(),
    ]
    if refers_to:
        lines += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: " + record_id(refers_to[0]).encode(), b"X-Refers-To-Page: " + (b"" if refers_to[1] is None else str(refers_to[1]).encode())]
    lines += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(length).encode()]
    return CRLF.join(lines) + CRLF


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.decode().lower(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:] if x)}


def records(stream) -> Iterator[tuple[bytes, bytes]]:
    """(header block, content) of each record of an open .warc stream; the content's length is that of the header."""
    while line := stream.readline():
        block = line
        while (line := stream.readline()) not in (CRLF, b""):
            block += line
        n = int(parse_header(block)["content-length"])
        content = stream.read(n)
        if len(content) != n or stream.read(4) != CRLF + CRLF:
            raise ValueError("a WARC record ends early")
        yield block, content


def _digested(pages: DataFrame) -> DataFrame:
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "coalesce(cast(html as binary), cast('' as binary)) payload")
    return rows.withColumns({"sha256": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long"), "uid": F.monotonically_increasing_id()})


def _revisits(digests: DataFrame) -> DataFrame:
    """(uid, first_uid, first_page) of the records that revisit another: those of shared digests, but for their responses."""
    first = digests.groupBy("sha256", "size").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "uid")).alias("first"), F.count("*").alias("n"))
    shared = written(first.filter("n > 1").select("sha256", "size", F.col("first.uid").alias("first_uid"), F.col("first.page_id").alias("first_page"), "n"), "shared")
    rows = spread_join(digests.filter(F.col("size") >= MIN_BYTES), shared.drop("n"), ["sha256", "size"], shared)
    return rows.filter("uid != first_uid").select("uid", "first_uid", "first_page")


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Write (page_id, url, html) as an archive below ``path``; return it.

    Payloads are written where they are read: which records are revisits goes back to the partitions of ``pages``, so no
    payload is shuffled. ``pages`` is read twice, in the same partitions; a table that isn't read from files is written first.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "warc")
    with scope(spark):
        pages = pages if scan_only(pages) else written(pages.select("page_id", "url", "html"), "pages")
        rows = _digested(pages)
        digests = written(rows.select("uid", "page_id", "sha256", "size"), "digests")
        again = _revisits(digests).select(F.shiftright("uid", 33).cast("int").alias("part"), F.col("uid").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "uid", "first_uid", "first_page")
        roles = by_part(again, "revisits", pages.rdd.getNumPartitions())

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            ctx, (store, root) = TaskContext.get(), filesystem(path)
            found = read_part(roles, ctx.partitionId(), ["row", "uid", "first_uid", "first_page"])
            role = {u: (f, p) for u, f, p in zip(*(found.column(c).to_pylist() for c in ("uid", "first_uid", "first_page")), strict=True)} if found is not None else {}
            tmp, out = f"{root}/_payloads-{ctx.partitionId():06d}-{ctx.taskAttemptId()}", None
            try:
                for b in batches:
                    uids, pages_, digests, heads = [], [], [], []
                    for page_id, url, payload, sha256, _, uid in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        args = (uid, page_id, url, base32_sha1(payload), sha256)
                        first = role.pop(uid, None)
                        stored = b"" if first else payload
                        if out is None:
                            store.create_dir(root, recursive=True)
                            out = store.open_output_stream(tmp)
                        out.write(gzip.compress(header("revisit" if first else "response", *args, len(stored), first) + CRLF + stored + CRLF + CRLF, 5, mtime=0))
                        uids.append(uid)
                        pages_.append(page_id)
                        digests.append(sha256)
                        heads.append(header("response", *args, len(payload)))
                    yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(pages_, pa.int64()), pa.array(digests, pa.string()), pa.array(heads, pa.binary())], names=["uid", "page_id", "sha256", "header"])
            finally:
                if out is not None:
                    out.close()
            if role:
                raise ValueError("the pages were not read in the same partitions again")
            if out is not None:
                publish(store, tmp, f"{root}/payloads-{ctx.partitionId():06d}.warc.gz")

        rows.select("page_id", "url", "payload", "sha256", "size", "uid").mapInArrow(write, "uid long, page_id long, sha256 string, header binary").write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


RECORDS = "uid long, page_id long, kind string, sha1 string, sha256 string, refers_to long, content binary"


def read_archive(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """Records of the archive's WARC files: uid, page_id, kind, sha1, sha256, refers_to, content (null for revisits).

    The planner sees no more than the list of files, so a join must be told not to broadcast the records. Without ``contents`` the
    content is left out, and so is the check of its digests.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/payloads-*.warc.gz"))
    names = [(str(s.getPath().getName()),) for s in found]
    if not names:
        return spark.createDataFrame([], RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows: list[tuple] = []
                    size = 0
                    for block, content in records(stream):
                        h = parse_header(block)
                        kind, sha1 = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                        if contents and kind == "response" and (base32_sha1(content) != sha1 or hashlib.sha256(content).hexdigest() != h["x-payload-sha256"]):
                            raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                        page, to = h["x-page-id"], h.get("x-refers-to-page")
                        rows.append((int(h["x-record"]), int(page) if page else None, kind, sha1, h["x-payload-sha256"], int(to) if to else None, content if contents and kind == "response" else None))
                        size += len(content)
                        if size > 8_000_000 or len(rows) >= 5_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return spark.createDataFrame(names, "name string").repartition(len(names)).mapInArrow(read, RECORDS).hint("merge")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def restore(spark: SparkSession, path: str, heads: DataFrame | None = None) -> DataFrame:
    """(uid, page_id, record): every original record, header and full payload, by a join on the digest; columns that ``heads``
    (rows of the headers table) has besides are passed on.

    A payload is copied to as many tasks as its records fill, so a digest that a third of the records share is spread.
    """
    own = spark.read.parquet(f"{path}/headers")
    heads = own if heads is None else heads
    payloads = read_archive(spark, path).filter("kind = 'response'").select("sha256", "content").dropDuplicates(["sha256"]).hint("merge")
    crlf = F.lit(bytearray(CRLF))
    joined = spread_join(heads, payloads, ["sha256"], own.groupBy("sha256").agg(F.count("*").alias("n")))
    return joined.select(*[c for c in heads.columns if c not in ("header", "sha256")], F.concat("header", crlf, "content", crlf, crlf).alias("record"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write an archive of ``pages`` and return a row per page from the records that are reconstructed from it: size and digest
    are those of the payload in the reconstructed record, type and reference those of the record in the WARC files."""
    spark = pages.sparkSession
    path = write_archive(pages)
    stored = read_archive(spark, path, contents=False).select("uid", "kind", "refers_to").hint("merge")
    heads = spark.read.parquet(f"{path}/headers").join(stored, "uid")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests = [], []
        for record in b.column(3):
            head, _, rest = record.as_py().partition(CRLF + CRLF)
            h, payload = parse_header(head + CRLF), rest[: -len(CRLF + CRLF)]
            digest = base32_sha1(payload)
            if len(payload) != int(h["content-length"]) or "sha1:" + digest != h["warc-payload-digest"]:
                raise ValueError(f"{h['warc-record-id']} was not reconstructed as it was")
            sizes.append(len(payload))
            digests.append(digest)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), b.column(1), b.column(2)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    whole = restore(spark, path, heads).select("page_id", "kind", "refers_to", "record")
    return map_rows(whole, f, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
