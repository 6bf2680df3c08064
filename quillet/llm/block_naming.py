"""Exact de-duplication by deterministic block naming (operator 7).

A text, white space removed, is cut into blocks of a fixed number of
characters.  All distinct blocks of the corpus are sorted and numbered; the
numbers are the blocks' names.  Then adjacent names are paired, the distinct
pairs are sorted and numbered in turn, and so on until each document is left
with one name.  Two documents have the same number of blocks and the same last
name if and only if their texts are equal: names stand for contents, not for
hashes, so there are no collisions to fear.

How it runs on Spark
--------------------
* The block contents cross the network once, in a ``groupBy`` whose map side
  already folds repeated blocks, so a text that holds a third of the rows sends
  one row per map task.  Hash partitioning and a sort by content inside each
  partition make ``monotonically_increasing_id`` a name that depends on the
  contents alone.
* Rows find their block's name by a 64-bit routing key and the length.  If two
  different blocks ever share a key (counted exactly), the rows are joined by
  content instead; the result is the same.
* Each level is checkpointed: names are never computed twice.  There are
  log2(longest text / block) levels, and only the documents that still have two
  names or more take part in one.
* A group of copies that holds more than a thousandth of all rows would be a hot
  key when rows look up their group.  There are at most ``HOT_GROUPS`` of these, so
  they are broadcast and the others are joined.

Edge cases: a null text is an empty one and all empty texts are equal; a
repeated row is a copy like any other and exactly one row of a group is kept,
also where rows share a doc_id; a null ``doc_id`` comes last among ties; extra
columns are ignored by ``exact_groups`` and kept by ``drop_exact_copies``, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, text_or_empty, with_row_ids

BLOCK_CHARS = 4096
#: As many groups at most are broadcast: those of more than 1 / HOT_GROUPS of all rows.
HOT_GROUPS = 1000


def squeezed(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def _routing_key(block: Column) -> Column:
    return F.struct(F.xxhash64(block).alias("h"), F.length(block).alias("n"))


def _number(distinct: DataFrame, *by: str) -> DataFrame:
    """Names for rows that are distinct and hash-partitioned by ``by``."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _first_names(placed: DataFrame) -> DataFrame:
    """The block rows with the name of their block instead of its text."""
    numbered = _number(placed.select("key", "block").distinct(), "block")
    names = cut(numbered.select("key", "name"))
    if names.groupBy("key").count().filter("count > 1").isEmpty():
        return cut(cut(placed.drop("block")).join(names, "key").drop("key"))
    by_block = cut(numbered.select("block", "name"))
    return cut(placed.drop("key").join(by_block, "block").drop("block"))


def _last_names(named: DataFrame) -> DataFrame:
    """(rid, name) of the documents of two blocks or more: pairs are named until one name is left."""
    rest = named.filter("n_blocks > 1").select("rid", F.col("n_blocks").alias("left"), "pos", "name")
    most = rest.agg(F.max("left")).first()[0] or 1
    done = []
    while most > 1:
        pairs = rest.groupBy("rid", "left", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = cut(pairs.withColumn("left", F.shiftright(F.col("left") + 1, 1)))
        names = cut(_number(pairs.select("a", "b").distinct(), "a", "b"))
        level = cut(pairs.join(names, ["a", "b"]).drop("a", "b"))
        done.append(level.filter("left = 1").select("rid", "name"))
        rest = level.filter("left > 1")
        most = (most + 1) // 2
    out = done[0] if done else rest.select("rid", "name")
    for level in done[1:]:
        out = out.unionByName(level)
    return out


def name_rows(rows: DataFrame, block_chars: int = BLOCK_CHARS, key=_routing_key) -> DataFrame:
    """rid, doc_id, n_code_points, text_sha256, n_blocks, name of every row (rid, doc_id, text).

    (n_blocks, name) is the collision-free identity of the squeezed text.
    ``key`` routes blocks to their names and need not be free of collisions.
    """
    source = rows.select("rid", "doc_id", text_or_empty().alias("text"))
    bare = source.select("rid", "doc_id", F.length("text").cast("long").alias("n_code_points"), squeezed(F.col("text")).alias("bare"))
    blocks = F.when(F.col("bare") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("bare", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    )
    digest = F.sha2(F.encode("bare", "UTF-8"), 256)
    cut_up = bare.select("rid", "doc_id", "n_code_points", digest.alias("text_sha256"), blocks.alias("blocks"))
    placed = cut_up.select("*", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)  # noqa: E731  a document's own values ride on its first block
    own = [first(c) for c in ("doc_id", "n_code_points", "text_sha256")]
    named = _first_names(placed.select("rid", *own, "n_blocks", "pos", "block", key(F.col("block")).alias("key")))
    own = named.filter("pos = 0").drop("pos")
    return own.filter("n_blocks = 1").unionByName(own.filter("n_blocks > 1").drop("name").join(_last_names(named), "rid"))


def _groups(named: DataFrame) -> DataFrame:
    """n_blocks, name, group_size and best: the row that stays."""
    best = F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), "doc_id", "rid")
    return named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), F.min(best).alias("best"))


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest doc_id (null last); of such rows under one doc_id,
    one.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    named = cut(name_rows(rows, **options))
    groups = _groups(named)
    hot = groups.filter(F.col("group_size") > max(20, named.count() // HOT_GROUPS))
    by = ["n_blocks", "name"]
    of_hot = named.join(F.broadcast(hot), by)
    others = named.join(F.broadcast(hot.select(by)), by, "left_anti").join(groups, by)
    return of_hot.unionByName(others).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one per group, with all their columns."""
    rows = with_row_ids(docs)
    kept = _groups(name_rows(rows.select("rid", "row.doc_id", "row.text"), **options)).select("best.rid")
    return rows.join(kept, "rid", "left_semi").select("row.*")
