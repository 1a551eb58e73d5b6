"""Connected components of a distributed edge list, by alternating large-star and small-star contraction.

Each round is two aggregations and two joins; labels fall to the least node of a component in a number of rounds that
grows with the logarithm of its diameter. Nothing is collected but one count and one checksum a round. Each round's
edges are a written table in the shared folder, so a lost executor repeats one round at most. A hub (a node with very many
edges) is spread in the joins over as many tasks as its edges fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, spread_join, written


def _with_least(sym: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours."""
    least = sym.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
    return spread_join(sym, least.select("u", "m"), ["u"], least.select("u", "n"))


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge, root being the least node (as a signed long) of its component.

    ``edges``: columns a and b, long. Loops and repeated edges do no harm; an empty list gives no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct(), "edges")
    mark = _sum(now)
    while mark[0]:
        sym = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _with_least(sym).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        small = _with_least(large.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        # u itself goes to m as well: each neighbour's row repeats it, so distinct() leaves one
        both = small.select(F.explode(F.array(F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        after = written(both.filter("hi != lo").distinct(), "edges")
        remove(now.sparkSession, now)
        now, before, mark = after, mark, _sum(after)
        if mark == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
