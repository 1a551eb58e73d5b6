"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, branches ranked by score.

Nodes have a tree, a parent (null at a root), a role, a text and a score. Joining the table of ancestors with itself
doubles their distance each round, so the number of rounds is the logarithm of the depth; each round also adds up the
scores and lengths of the two stretches. A branch is ranked by its sum, then its length, then its first leaf. The chosen
leaves' paths are then laid out with the same tables, distances 1, 2, 4, ... in turn, so only chosen paths are built.

A turn is written ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline. In texts and roles ``<|`` never stays: a
backslash is put between, one more where backslashes stand there already, so that it can be taken out again; a role's
newlines and backslashes are escaped too. The output has rows of (conv_id, first, text, spans): pieces of a formatted
conversation that end at turns and hold ``PIECE_CHARS`` code points or one turn; spans are the code points of the loss
mask, the assistant's texts. Pieces of one conversation can lie in several partitions, so a huge one needs no large task;
joined in order of ``first`` they are the conversation.

Defined cases: null text and null role are empty; null turns come first, and rows of one turn are ordered by role and
text; a null conv_id is a conversation of its own; no rows give no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import kept, remove, scope, written

START, END = "<|im_start|>", "<|im_end|>"
PIECE_CHARS = 1_000_000
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """The formatted turn, and the loss span in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", (len(head), len(head) + len(body)) if role == LOSS_ROLE else None


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted piece."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn does not start where the last one ends")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def chain_nodes(turns: DataFrame) -> DataFrame:
    """Reply trees without branches from (conv_id, turn, role, text): each turn answers the one before.

    Rows are sorted by ranges, so a long conversation is spread over partitions; only the last row of each partition
    reaches the driver, to be the parent of the next one's first.
    """
    text = turns.selectExpr("cast(conv_id as long) tree", "cast(turn as long) turn", "coalesce(cast(role as string), '') role", "coalesce(cast(text as string), '') text")
    order = [F.col("tree").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    ranged = text.repartitionByRange(*order).sortWithinPartitions(*order[:3], "text")
    ranged = written(ranged.select("tree", "role", "text", F.monotonically_increasing_id().alias("node"), F.spark_partition_id().alias("part")), "turns")
    own = Window.partitionBy("part", "tree").orderBy("node")  # within a partition's stretch of one conversation
    held = ranged.select("tree", "node", "part", F.lag("node").over(own).alias("parent"))
    edges = sorted(ranged.groupBy("part").agg(F.min_by("tree", "node").alias("first_tree"), F.min("node").alias("first"), F.max_by("tree", "node").alias("last_tree"), F.max("node").alias("last")).collect(), key=lambda r: r["part"])
    joins = [(b["first"], a["last"]) for a, b in zip(edges, edges[1:], strict=False) if a["last_tree"] == b["first_tree"]]
    if joins:  # one row for each partition at most
        across = turns.sparkSession.createDataFrame(joins, "node long, before long")
        held = held.join(F.broadcast(across), "node", "left").withColumn("parent", F.coalesce("parent", "before"))
    return ranged.select("node", "tree", "role", "text").join(held.select("node", "parent"), "node").withColumn("score", F.lit(0.0))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, path, seq, node) of the ``top`` branches of each tree: path is the leaf, seq counts from the root.

    ``nodes``: node (unique), tree, parent, score.
    """
    spark = nodes.sparkSession
    tables: list[DataFrame] = []
    # A parent that is no node makes a root. Roots look for themselves, so that no task gets all rows without a parent.
    known = nodes.select(F.col("node").alias("wanted"), F.col("node").alias("known"))
    asked = nodes.select("node", "tree", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("parent", "node").alias("wanted"))
    base = written(asked.join(known, "wanted", "left").select("node", "tree", F.when(F.col("parent").isNotNull(), F.col("known")).alias("parent"), "score"), "nodes")
    # Nodes whose pointer has passed the root are done: only the open ones are joined and written again.
    first = written(base.select("node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "ancestors")
    levels, done, now, n = [], first.filter("up is null"), first, first.count()
    while not (open_ := now.filter("up is not null")).isEmpty():
        if 1 << len(levels) > 2 * n:  # no path is longer than there are nodes
            raise ValueError("the replies form a cycle")
        levels.append(open_)
        b = done.unionByName(open_).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        now = written(open_.join(b, "up").select("node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")), "ancestors")
        done = done.unionByName(now.filter("up is null"))
        tables.append(now)
    now = done
    leaves = base.join(base.select(F.col("parent").alias("node")).filter("node is not null").distinct(), "node", "left_anti").join(now.select("node", "total", "depth"), "node")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node"))
    chosen = leaves.withColumn("rank", rank).filter(F.col("rank") <= top)
    members = written(chosen.select("tree", F.col("node").alias("path"), "depth", "node", F.lit(0).cast("long").alias("up_by")), "members")
    for k, level in enumerate(levels):
        more = members.join(level.select("node", "up"), "node").select("tree", "path", "depth", F.col("up").alias("node"), (F.col("up_by") + (1 << k)).alias("up_by"))
        members = members.unionByName(written(more, "members"))
    remove(spark, first, base, *tables)
    return members.select("tree", "path", (F.col("depth") - 1 - F.col("up_by")).alias("seq"), "node")


def formatted(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Pieces (conv_id, path, first, text, spans) of the chosen paths of reply trees, written in the shared folder."""
    with scope(nodes.sparkSession):
        return _formatted(nodes, best_paths(nodes, top))


def _formatted(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    turns = paths.join(nodes.select("node", "role", "text"), "node").select("tree", "path", "seq", "role", "text")
    order = [F.col("tree").asc_nulls_first(), F.col("path"), F.col("seq")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, spans_type = ["conv_id", "path", "first", "text", "spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def made(rows: list) -> pa.RecordBatch:
            c = [*zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], spans_type)], names=names)

        key, parts, spans, size, done, held = None, [], [], 0, [], 0
        for b in batches:
            for r in b.to_pylist():
                if key is not None and ((r["tree"], r["path"]) != key[:2] or size >= PIECE_CHARS):
                    done.append((*key, "".join(parts), spans))
                    held, key, parts, spans, size = held + size, None, [], [], 0
                    if held > 4_000_000 or len(done) >= 5_000:
                        yield made(done)
                        done, held = [], 0
                if key is None:
                    key = (r["tree"], r["path"], r["seq"])
                text, span = format_turn(r["role"], r["text"])
                if span:
                    spans.append({"start": size + span[0], "end": size + span[1]})
                parts.append(text)
                size += len(text)
        if key is not None:
            done.append((*key, "".join(parts), spans))
        if done:
            yield made(done)

    return kept(ranged.mapInArrow(write, "conv_id long, path long, first long, text string, spans array<struct<start:int,end:int>>"), "formatted")


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from its pieces in order; streamed, so memory is bounded by a piece.

    A digest of a whole conversation is one pass over it by nature; formatting and parsing are not.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, state = None, None

        def closed() -> tuple:
            n, turns, loss_chars, loss, chars = state
            return (key[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        def made(rows: list) -> pa.RecordBatch:
            c = [*zip(*rows, strict=True)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for r in b.to_pylist():
                if (r["conv_id"], r["path"]) != key:
                    if key is not None:
                        rows.append(closed())
                    key, state = (r["conv_id"], r["path"]), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["text"]
                for role, turn in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{turn}\n".encode("utf-8", "surrogatepass"))
                for s in r["spans"]:
                    loss = unescape(text[s["start"] : s["end"]])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(rows) >= 5_000:
                yield made(rows)
                rows = []
        if key is not None:
            rows.append(closed())
        if rows:
            yield made(rows)

    ordered = pieces.repartition("conv_id", "path").sortWithinPartitions("conv_id", "path", "first")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
