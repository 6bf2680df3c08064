"""Connected components by alternating stars, in joins and aggregates alone.

Edge cases: edges from a node to itself and repeated edges add nothing; a node
without an edge is not in the result; a null node is no node, so its edges fall
out; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()


def _with_least(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` with m, the least v of their u, and (u, m) of every u.

    The minima of nodes with more than ``limit`` edges are broadcast (there are at most edges / limit
    of them), so the edges of such a node stay where they lie; the others are joined by u.
    """
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    heavy = F.broadcast(least.filter(F.col("n") > limit).select("u", "m"))
    light = least.filter(F.col("n") <= limit).select("u", "m")
    rest = edges.join(heavy.select("u"), "u", "left_anti").join(light, "u")
    return edges.join(heavy, "u").unionByName(rest), least.select("u", "m")


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked, _ = _with_least(both, limit)
    return linked.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    linked, least = _with_least(edges, limit)
    moved = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Nodes of which the minima are broadcast at most, and the edges a node has for it at least.
HEAVY, MANY = 1_000, 10_000


def connected_components(edges: DataFrame, many: int = MANY) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node.

    Each round is two aggregates and two joins on narrow rows, and is
    checkpointed; the number of rounds grows with the logarithm of the graph.
    A node that many others touch never gathers them in one task: its minimum is combined
    before the shuffle and broadcast.  Nothing is collected.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        limit = max(many, 2 * mark[0] // HEAVY)
        now = cut(_small_star(cut(_large_star(now, limit)), limit))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
