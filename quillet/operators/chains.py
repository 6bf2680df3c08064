"""Version chains by their links, by pointer doubling (DOC-3).

A document's chain is what ``supersedes_id`` reaches from it, until there is no further
document, or one that the chain already has.  Each round every document asks its pointer
for the pointer's own, so a chain of n links takes log2(n) rounds of one join on narrow rows.
Who is still climbing after a round in which nobody arrived is on a cycle or leads into one: a chain of any length
holds documents of every shorter length, and some of those would have arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cut


def _climb(links: DataFrame) -> DataFrame:
    """(id, up, n, last) of (id, up): links to the end of each chain and the document there; ``up`` stays set where there is no end."""
    state = cut(links.select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("n"), F.coalesce("up", "id").alias("last")))
    before = -1
    while (climbing := state.filter("up is not null").count()) not in (0, before):
        before = climbing
        step = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("last").alias("last2"))
        moved = state.filter("up is not null").join(step, "up").select("id", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), F.col("last2").alias("last"))
        state = cut(state.filter("up is null").unionByName(moved))
    return state


def _on_cycles(links: DataFrame) -> DataFrame:
    """(id): documents on cycles, of links (id, up) that never end: what is left as pointers double once no document falls out."""
    state, left = cut(links), -1
    while (now := state.select("up").distinct().count()) != left:
        left = now
        state = cut(state.join(state.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up").select("id", F.col("up2").alias("up")))
    return state.select(F.col("up").alias("id")).distinct()


def _cycle_names(links: DataFrame) -> DataFrame:
    """(id, cycle): the smallest document of each cycle, of links (id, up) within cycles."""
    state, changed = cut(links.select("id", "up", "id").toDF("id", "up", "cycle")), 1
    while changed:
        step = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("cycle").alias("cycle2"))
        state = cut(state.join(step, "up").select("id", F.col("up2").alias("up"), F.least("cycle", "cycle2").alias("cycle"), (F.col("cycle2") < F.col("cycle")).alias("less")))
        changed = state.filter("less").count()
        state = state.drop("less")
    return state.select("id", "cycle")


def version_chains(docs: DataFrame) -> DataFrame:
    """doc_id, place (documents of its chain, itself included), oldest (where the chain ends) and cyclic, of (doc_id, supersedes_id).

    A link to a document that is not there ends the chain.  A chain that comes back to itself ends before the
    document that it already has.
    """
    docs = cut(docs.select(F.col("doc_id").alias("id"), F.col("supersedes_id").alias("up")))
    there = docs.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    links = docs.join(there, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up"))
    state = _climb(links)
    ended = state.filter("up is null").select(F.col("id").alias("doc_id"), (F.col("n") + 1).alias("place"), F.col("last").alias("oldest"), F.lit(False).alias("cyclic"))
    endless = cut(links.join(state.filter("up is not null").select("id"), "id", "left_semi"))
    if endless.isEmpty():
        return ended
    cycle = cut(_on_cycles(endless))
    ring = cut(endless.join(cycle, "id", "left_semi"))
    names = cut(_cycle_names(ring))
    sizes = names.groupBy("cycle").agg(F.count("*").alias("size"))
    # Each document on a cycle is the end of the chains that enter there; the chain's last one is the one that links back to it.
    entries = ring.select(F.col("up").alias("last"), F.col("id").alias("oldest")).join(names.join(sizes, "cycle").select(F.col("id").alias("last"), "size"), "last")
    tails = _climb(endless.join(cycle.withColumn("on", F.lit(True)), "id", "left").select("id", F.when(F.col("on").isNull(), F.col("up")).alias("up")))
    cyclic = tails.join(entries, "last").select(F.col("id").alias("doc_id"), (F.col("n") + F.col("size")).alias("place"), "oldest", F.lit(True).alias("cyclic"))
    return ended.unionByName(cyclic)
