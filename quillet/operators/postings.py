"""A written index of chunks: postings of words, and each chunk's words for comparison by 3-grams (RET-1, RET-2).

An index is a folder, written once and read as often as wanted, of bucketed tables:

* ``words``: (term, vec_id), a row per word of a chunk, bucketed by term, and ``terms``: (term, df), the chunks that hold a word;
* ``chunks``: (vec_id, words), bucketed by vec_id.

No row of a chunk is shuffled to write it.  A full-text search is a join: a query meets only the postings of its rarest
word, and what it meets is verified against the chunk's words.  A 3-gram search sends the queries in
bounded blocks to where the chunks lie and counts what each chunk has in common with all of
a block by one matrix product, so no pair of a chunk and a query is a row unless it is among the best.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .blocks import in_blocks, shared_folder

#: The least similarity that is searched for, queries of a block, and chunks of a matrix.
SIMILAR = 0.3
MAX_ASKED, SLICE = 1_000, 500

_TABLES = {
    "words": ("term string, vec_id bigint", "term"),
    "terms": ("term string, df bigint", "term"),
    "chunks": ("vec_id bigint, words array<string>", "vec_id"),
}


def words(text: str) -> Column:
    """The words of a text column, in lower case, in order."""
    return F.expr(rf"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+', 0)")


def _name(folder: str, table: str) -> str:
    return f"postings_{hashlib.md5(folder.encode()).hexdigest()[:16]}_{table}"


def _write(df: DataFrame, folder: str, table: str, buckets: int) -> DataFrame:
    columns, key = _TABLES[table]
    df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{table}").format("parquet").saveAsTable(_name(folder, table))
    return df.sparkSession.table(_name(folder, table))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the index; a session that did not write it is told of its buckets first."""
    full = _name(folder, name)
    if not spark.catalog.tableExists(full):
        columns, key = _TABLES[name]
        n = spark.read.parquet(f"{folder}/buckets").first()["buckets"]
        spark.sql(f"CREATE TABLE {full} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{folder}/{name}'")
    return spark.table(full)


def build(chunks: DataFrame, folder: str | None = None, buckets: int | None = None, legs: tuple[str, ...] = ("words", "grams")) -> str:
    """Index (vec_id, text) in ``folder`` for one or both ``legs`` and give its name; vec_id tells chunks apart."""
    spark = chunks.sparkSession
    folder = folder or f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/buckets")
    held = _write(chunks.select(F.col("vec_id").cast("long").alias("vec_id"), words("text").alias("words")), folder, "chunks", buckets)
    if "words" in legs:
        postings = _write(held.select(F.explode(F.array_distinct("words")).alias("term"), "vec_id"), folder, "words", buckets)
        _write(postings.groupBy("term").agg(F.count("*").alias("df")), folder, "terms", buckets)
    return folder


def _ranked(scored: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def lexical(queries: DataFrame, folder: str, score: Callable[[Column], Column], n: int = 50, within: DataFrame | None = None) -> DataFrame:
    """The best ``n`` chunks that hold every word of a query (query_id, query), by ``score`` over the places of its words (place, term).

    ``within`` (vec_id) bounds what is searched.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.array_distinct(words("query")).alias("asked")).filter(F.size("asked") > 0)
    each = asked.select("query_id", F.explode("asked").alias("term")).join(table(spark, folder, "terms"), "term", "left")
    df = F.coalesce("df", F.lit(0))
    rarest = each.groupBy("query_id").agg(F.min_by("term", F.struct(df, "term")).alias("term"), F.min(df).alias("df")).filter("df > 0").select("query_id", "term")
    met = rarest.join(table(spark, folder, "words").select("term", "vec_id"), "term").select("query_id", "vec_id")
    met = met if within is None else met.join(within, "vec_id", "left_semi")
    whole = met.join(asked, "query_id").join(table(spark, folder, "chunks").select("vec_id", "words"), "vec_id")
    whole = whole.filter(F.size(F.array_intersect("asked", "words")) == F.size("asked"))
    entries = F.expr("filter(transform(words, (w, i) -> named_struct('place', i, 'term', w)), x -> array_contains(asked, x.term))")
    return _ranked(whole.select("query_id", "vec_id", F.round(score(entries), 9).alias("score")), n)


def _trigrams(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of the different 3-grams of each row's words, each word with two blanks before and one after, by row; a gram is its three code points as a number."""
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    padded = [f"  {w} " for w in flat.to_pylist()]
    size = np.array([len(w) for w in padded], np.int64)
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.repeat(np.arange(len(lists)), np.diff(offsets)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(points))  # characters of the word from here on
    at = np.flatnonzero(left > 2)
    grams = points[at] << 42 | points[at + 1] << 21 | points[at + 2]
    order = np.lexsort((grams, row[at]))
    row, grams = row[at][order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return row[new], grams[new]


def similar(queries: DataFrame, folder: str, n: int = 50, least: float = SIMILAR, within: DataFrame | None = None) -> DataFrame:
    """The best ``n`` chunks whose share of common 3-grams with a query (query_id, query) is over ``least``.

    Queries are broadcast in blocks of ``MAX_ASKED`` at most.  A task counts the common 3-grams of some chunks
    and all queries of the block as a product of two matrices of zeros and ones, which is exact, and keeps its best per query.
    """
    if least < SIMILAR:
        raise ValueError(f"the index serves similarities from {SIMILAR}")
    chunks = table(queries.sparkSession, folder, "chunks").select("vec_id", "words")
    chunks = chunks if within is None else chunks.join(within, "vec_id", "left_semi")
    asked = queries.select("query_id", words("query").alias("words")).filter(F.size("words") > 0)
    return _ranked(in_blocks(asked, MAX_ASKED, lambda rows: _compared(rows, asked.schema["query_id"].dataType, chunks, n, least)), n)


def _compared(rows: list[Row], kind: DataType, chunks: DataFrame, n: int, least: float) -> tuple[DataFrame, Broadcast]:
    """(query_id, vec_id, score): the best ``n`` chunks of each batch for each query."""
    of, grams = _trigrams(pa.array([r["words"] for r in rows], pa.list_(pa.string())))
    known, at = np.unique(grams, return_inverse=True)
    holds = np.zeros((len(known), len(rows)), np.float32)
    holds[at, of] = 1
    arrow = to_arrow_type(kind)
    shared = chunks.sparkSession.sparkContext.broadcast((pa.array([r["query_id"] for r in rows], arrow), known, holds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, holds = shared.value
        asked = holds.sum(0, dtype=np.float64)
        for batch in batches:
            best: list[tuple[np.ndarray, ...]] = []
            for a in range(0, batch.num_rows if len(known) else 0, SLICE):
                some = batch.slice(a, SLICE)
                row, grams = _trigrams(pa.concat_arrays([some["words"]]))
                place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                met = known[place] == grams
                own = np.zeros((some.num_rows, len(known)), np.float32)
                own[row[met], place[met]] = 1
                common = (own @ holds).astype(np.float64)
                share = common / np.maximum(asked[None, :] + np.bincount(row, minlength=some.num_rows)[:, None] - common, 1)
                i, q = np.nonzero(share > least)
                best = [_first(best, (q, some["vec_id"].to_numpy()[i], np.round(share[i, q], 9)), n)]
            if best:
                q, own_ids, score = best[0]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(own_ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return chunks.mapInArrow(run, f"query_id {kind.simpleString()}, vec_id long, score double"), shared


def _first(best: list[tuple[np.ndarray, ...]], more: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, ...]:
    """Of (query, vec_id, score) the first ``n`` of each query, as they rank in the end."""
    q, ids, score = (np.concatenate(c) for c in zip(*best, more))
    order = np.lexsort((ids, -score, q))
    q = q[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < n], ids[order][place < n], score[order][place < n]


def per_row(function: Callable[[list], float]) -> Callable[[Column], Column]:
    """A score of the matched places of a row; only matches reach it."""

    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(function)

    return run

