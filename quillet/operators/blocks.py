"""Lineage cuts, and query sets of any size in bounded blocks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: ``spark.checkpoint.dir``; where that is unset, one of this machine's if it is alone, else the warehouse's."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[.*)?", context.master):
            named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_intermediate")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, keys: list[str], order: list[str], take: str) -> DataFrame:
    """Adds _place, _total, _before and _after: a row's number within its ``keys``, their rows, and ``take`` of its neighbours.

    No group has to fit a task: rows are dealt by ranges of keys and order, each range
    numbers its own, and a table with one row per range and group says how many rows
    of the group come before the range and what stands at its ends.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    at = F.struct(*order)
    ends = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"), F.min_by(take, at).alias("_head"), F.max_by(take, at).alias("_tail"))
    along = W.partitionBy(*keys).orderBy("_range")
    ends = ends.select(
        F.col("_range").alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
        F.lag("_tail").over(along).alias("_tail"), F.lead("_head").over(along).alias("_head"), F.sum("_n").over(W.partitionBy(*keys)).alias("_total"),
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = W.partitionBy("_range", *keys).orderBy(*order)
    return ranged.join(ends, same).select(
        *df.columns, (F.col("_earlier") + F.row_number().over(own)).alias("_place"), "_total",
        F.coalesce(F.lag(take).over(own), "_tail").alias("_before"), F.coalesce(F.lead(take).over(own), "_head").alias("_after"),
    )


def in_blocks(queries: DataFrame, limit: int, run: Callable[[list[Row]], tuple[DataFrame, Broadcast]]) -> DataFrame:
    """The results of ``run`` (a frame and the broadcast it reads) over all ``queries``, at most ``limit`` of them at a time.

    A larger set is dealt into blocks by the hash of query_id; each block's result is
    checkpointed and its broadcast destroyed before the next, so the driver holds one
    block.  Rows of one query_id share a block, and there may be ``limit`` of them.
    """
    rows = queries.limit(limit + 1).collect()
    if len(rows) <= limit:
        return run(rows)[0]
    queries = cut(queries)
    if queries.groupBy("query_id").count().filter(F.col("count") > limit).count():
        raise ValueError(f"more than {limit} rows of one query_id")
    n = -(-queries.count() // limit)
    while True:
        dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n)))
        sizes = dealt.groupBy("_block").count().collect()  # one row per block
        if max(r["count"] for r in sizes) <= limit:
            break
        n += -(-n // 4)
    out = []
    for block in sorted(r["_block"] for r in sizes):
        found, shared = run(dealt.filter(F.col("_block") == block).drop("_block").collect())
        # Dealt anew, lest the union count as partitioned by query.
        out.append(cut(found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
        shared.destroy()
    return reduce(DataFrame.unionByName, out)
