"""Mixing sources to target weights (operator 4).

The words of each source are added up, a repetition rate is derived for each
source, and every document is emitted floor(rate) times plus one more time with
probability equal to the fraction.  The draw is a hash of the document's id and
a seed, so reruns and recomputed tasks agree.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...;
they share all words of the corpus by weight, no target exceeds ``MAX_REPEATS``
times its source, and what is cut off is shared again by weight until none is
above.  That is a water level L with sum(min(cap, L * weight)) = total, found in
closed form over the table of sources.

Only the table of sources (one row each) is ever shuffled or broadcast.  Sources
may be as many as hosts: their order and the sums along it come from ranges, one
task each, and a table of one row per range that says what lies before it; no
task sees all sources.  The table is broadcast when it has at most
``BROADCAST_SOURCES`` rows; beyond that the documents are joined by source, and
adaptive execution splits hot sources.

Edge cases: a null text has no words; a document without words has nothing to
take and is not emitted unless its rate is one or more; null is a source of its
own; rows repeated under one id share their draw; extra columns are kept by
``mixed`` and ignored by ``plan``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, shuffle_partitions, text_or_empty

MAX_REPEATS = 3
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def running(df: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums over all rows up to it in the order of ``by`` (null last), rows of equal ``by`` included.

    Rows are dealt by ranges of ``by``; each range sums its own rows, and adds what the
    ranges before it come to.
    """
    order = F.col(by).asc_nulls_last()
    parts = shuffle_partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range: a fixed number
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    own = W.partitionBy("_range").orderBy(order)
    summed = ranged.join(F.broadcast(before), "_range").withColumns({name: F.col(f"_{name}") + F.sum(c).over(own) for name, c in sums.items()})
    return summed.drop("_range", *[f"_{name}" for name in sums])


def source_targets(docs: DataFrame) -> DataFrame:
    """source, source_size, target, rate: one row per source."""
    sizes = cut(docs.groupBy("source").agg(F.sum(n_words(text_or_empty())).alias("source_size")))
    weight = ((F.col("place") - 1) % 3 + 1).cast("long")
    weighed = running(sizes, "source", {"place": F.lit(1)}).select("source", "source_size", weight.alias("weight"))
    total, weights = weighed.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("source_size", "weight")]).first()
    capped = weighed.withColumn("cap", MAX_REPEATS * F.col("source_size"))
    level = capped.withColumn("level", F.col("cap") / F.col("weight"))
    # At the level where this source is full: what the sources that are full take, and the weight of the others.
    filled = running(level, "level", {"full": F.col("cap"), "full_weight": F.col("weight")})
    is_full = F.col("full") + F.col("level") * (weights - F.col("full_weight")) <= total
    filled = cut(filled.withColumn("is_full", is_full))
    full = filled.filter("is_full").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("cap", "weight")]).first()
    share = (total - full[0]) / max(weights - full[1], 1) * F.col("weight")
    out = filled.withColumn("target", F.when(F.col("is_full"), F.col("cap").cast("double")).otherwise(F.lit(1.0) * share))
    rate = F.when(F.col("is_full"), F.lit(float(MAX_REPEATS))).otherwise(F.least(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(float(MAX_REPEATS))))
    return cut(out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, rate).otherwise(F.lit(0.0)).alias("rate")))


def with_copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """_row (all of the row), source_size, target and copies for every row of ``docs``."""
    targets = source_targets(docs).withColumnRenamed("source", "_source")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = docs.select(F.struct("*").alias("_row"))
    joined = rows.join(targets, F.col("_row.source").eqNullSafe(F.col("_source")))
    whole = F.floor("rate")
    extra = (draw(F.col("_row.doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.select("_row", "source_size", "target", (whole + extra).alias("copies"))


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of ``docs``."""
    sized = with_copies(docs.select("doc_id", "text", "source"), seed)
    size = n_words(F.coalesce(F.col("_row.text"), F.lit("")))
    out = sized.select(F.col("_row.doc_id").alias("doc_id"), size.alias("size"), "source_size", "target", "copies")
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    return with_copies(docs, seed).select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
