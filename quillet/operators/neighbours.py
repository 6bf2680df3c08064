"""Approximate neighbours by inverted lists with residual product codes (EMB-7).

An index is a folder, written once and read as often as wanted:

* ``model``: one row with the centroids of the lists, the codebooks, the directory and the size of each list;
* ``codes`` and ``vectors``: (list, vec_id, code) and (list, vec_id, embedding), partitioned by ``part``, a directory of
  neighbouring lists, and sorted by list inside.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed.  A vector's
code has one byte for every four dimensions of what its list's centroid leaves.  A
query looks into its nearest lists until they hold ``visit`` of all vectors; only their
directories and lists are read (partition filter and pushed filter).  Codes give approximate scores; the
best ``rerank`` of each query are compared exactly.  The queries travel in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import in_blocks, shared_folder
from .vectors import MAX_QUERIES

#: Rows that centroids and codebooks are fitted on at most, chosen by a hash of the id.
SAMPLE = 20_000
#: Lists at most (else 16 times the root of the number of vectors), and lists of a directory.
LISTS, LISTS_A_PART = 4_096, 16
#: Share of the vectors in the lists that a query looks into, and candidates compared exactly for each result.
VISIT, RERANK = 0.25, 20
#: Dimensions of a byte of code, rows of a file.
STRIP, FILE_ROWS = 4, 1_000_000
#: Queries whose lists are found at once, and queries that meet a batch of codes at once.
PROBED, ASKED = 1_024, 256
_ROUNDS = 10


class Model(NamedTuple):
    """Unit centroids, their directories, the vectors of each list, and the codebooks (strip, code, dimension)."""

    centroids: np.ndarray
    part: np.ndarray
    size: np.ndarray
    books: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; no rows make a matrix without rows."""
    rows = column.to_pylist()
    return np.array(rows, np.float64) if rows else np.zeros((0, 1))


def _spherical(m: np.ndarray, k: int) -> np.ndarray:
    """``k`` unit centroids of the rows."""
    if len(m) <= k:
        return m
    centres = m[np.random.default_rng(0).choice(len(m), k, replace=False)]
    for _ in range(_ROUNDS):
        nearest = np.concatenate([(m[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(m), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, m)
        used = np.bincount(nearest, minlength=k) > 0
        centres[used] = _unit(sums[used])
    return centres


def _codebook(x: np.ndarray, k: int = 256) -> np.ndarray:
    """``k`` centres of the rows by squared distance; fewer rows are repeated."""
    if len(x) <= k:
        return np.resize(x, (k, x.shape[1])) if len(x) else np.zeros((k, x.shape[1]))
    centres = x[np.random.default_rng(1).choice(len(x), k, replace=False)]
    for _ in range(_ROUNDS):
        nearest = _nearest(x, centres)
        count = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, x[:, d], k) for d in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def _strips(m: np.ndarray) -> list[np.ndarray]:
    """The dimensions in strips of ``STRIP``, the last filled with zeros."""
    wide = np.pad(m, ((0, 0), (0, -m.shape[1] % STRIP)))
    return [wide[:, a : a + STRIP] for a in range(0, wide.shape[1], STRIP)]


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of (vec_id, embedding); list sizes are still zero."""
    n = vectors.count()
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    m = _unit(_matrix(rows["embedding"].combine_chunks()))
    lists = min(LISTS, len(m), max(1, round(16 * n**0.5))) if lists is None else lists
    centroids = _spherical(m, lists)
    parts = _spherical(centroids, max(1, len(centroids) // LISTS_A_PART))
    part = (centroids @ parts.T).argmax(1) if len(centroids) else np.zeros(0, np.int64)
    left = m - centroids[(m @ centroids.T).argmax(1)] if len(centroids) else m
    return Model(centroids, part, np.zeros(len(centroids), np.int64), np.stack([_codebook(x) for x in _strips(left)]))


def _save(spark: SparkSession, model: Model, kind: str, folder: str) -> None:
    packed = [(kind, *(bytearray(np.ascontiguousarray(x, kind).tobytes()) for x, kind in zip(model, ("<f8", "<i8", "<i8", "<f8"))), model.centroids.shape[1], len(model.books))]
    spark.createDataFrame(packed, "kind string, centroids binary, part binary, size binary, books binary, dims int, strips int").coalesce(1).write.parquet(f"{folder}/model")


def load(spark: SparkSession, folder: str) -> Model:
    r = spark.read.parquet(f"{folder}/model").first()
    part = np.frombuffer(r["part"], "<i8")
    return Model(np.frombuffer(r["centroids"], "<f8").reshape(len(part), r["dims"]), part, np.frombuffer(r["size"], "<i8"), np.frombuffer(r["books"], "<f8").reshape(r["strips"], 256, STRIP))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``codes`` or ``vectors`` of the index."""
    last = "code binary" if name == "codes" else f"embedding {spark.read.parquet(f'{folder}/model').first()['kind']}"
    return spark.read.schema(f"list int, vec_id long, {last}, part int").parquet(f"{folder}/{name}")


def build(vectors: DataFrame, folder: str | None = None, lists: int | None = None) -> str:
    """Index all of (vec_id, embedding) in ``folder`` and give its name.

    Rows are dealt by list, and within a list of more than ``FILE_ROWS`` by the id, so a list of any size is
    spread over tasks and files.
    """
    spark = vectors.sparkSession
    folder = folder or f"{shared_folder(spark)}/index-{np.random.default_rng().integers(1 << 62)}"
    model = fit(vectors, lists)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch["embedding"]))
            nearest = (v @ m.centroids.T).argmax(1)
            codes = np.stack([_nearest(x, book) for x, book in zip(_strips(v - m.centroids[nearest]), m.books)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.part[nearest], pa.int32()), pa.array(nearest, pa.int32()), batch["vec_id"], pa.array([c.tobytes() for c in codes], pa.binary()), batch["embedding"]],
                ["part", "list", "vec_id", "code", "embedding"],
            )

    kind = vectors.schema["embedding"].dataType.simpleString()
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    listed = read.mapInArrow(run, f"part int, list int, vec_id long, code binary, embedding {kind}")
    stored = f"{folder}/assigned"
    listed.write.parquet(stored)
    listed = spark.read.schema(listed.schema).parquet(stored)
    size = np.zeros(len(model.centroids), np.int64)
    for r in listed.groupBy("list").count().collect():  # one row per list
        size[r["list"]] = r["count"]
    _save(spark, model._replace(size=size), kind, folder)
    files = F.lit(max(1, -(-int(size.max(initial=0)) // FILE_ROWS)))
    dealt = listed.repartition("part", F.pmod(F.xxhash64("vec_id"), files)).sortWithinPartitions("part", "list")
    dealt.select("part", "list", "vec_id", "code").write.partitionBy("part").parquet(f"{folder}/codes")
    dealt.select("part", "list", "vec_id", "embedding").write.partitionBy("part").parquet(f"{folder}/vectors")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    shared.destroy()
    return folder


def probes(model: Model, q: np.ndarray, visit: float) -> np.ndarray:
    """Which lists each query looks into: the nearest ones, one at least, up to ``visit`` of all vectors."""
    order = np.argsort(-(q @ model.centroids.T), axis=1, kind="stable")
    held = np.cumsum(model.size[order], axis=1)
    within = held <= visit * model.size.sum()
    within[:, :1] = True
    looked = np.zeros(order.shape, bool)
    np.put_along_axis(looked, order, within, axis=1)
    return looked


def lists_read(table: DataFrame, model: Model, looked: np.ndarray) -> DataFrame:
    """``table`` (codes or vectors) without the directories and lists that no query looks into."""
    lists = np.flatnonzero(looked.any(0))
    parts = np.unique(model.part[lists])
    return table.filter(F.col("part").isin([int(p) for p in parts]) & F.col("list").isin([int(x) for x in lists]))


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, visit: float = VISIT, rerank: int = RERANK) -> DataFrame:
    """(query_id, vec_id, score, rank): about the best ``k`` of each query (query_id, embedding) by cosine, ties by id.

    Each batch of codes keeps its ``k * rerank`` best per query, so the shuffle carries no more than that
    per query and batch; the exact scores are made where the wanted vectors lie.
    """
    return in_blocks(queries.toDF("query_id", "embedding"), MAX_QUERIES, lambda rows: _search(spark, folder, rows, k, visit, k * rerank))


def _search(spark: SparkSession, folder: str, rows: list[Row], k: int, visit: float, keep: int) -> tuple[DataFrame, Broadcast]:
    model = load(spark, folder)
    ids = np.array([r[0] for r in rows], np.int64)
    if rows and len(model.centroids):
        q = _unit(np.array([r[1] for r in rows], np.float64))
        # Which lists each query looks into, as bits; all else that a query and a list or code give is made in the tasks.
        looked = np.concatenate([np.packbits(probes(model, q[a : a + PROBED], visit), axis=1) for a in range(0, len(q), PROBED)])
    else:  # nothing asked or nothing to find: no list is read
        q, looked = np.zeros((0, 1)), np.zeros((0, -(-len(model.centroids) // 8)), np.uint8)
    union = np.unpackbits(np.bitwise_or.reduce(looked, axis=0), count=len(model.centroids)).astype(bool)[None, :] if len(looked) else np.zeros((0, len(model.centroids)), bool)
    shared = spark.sparkContext.broadcast((ids, q, looked, model.centroids, model.books))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, looked, centroids, books = shared.value
        for batch in batches:
            lists, own = batch["list"].to_numpy(), batch["vec_id"].to_numpy()
            codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(own), -1)
            there, at = np.unique(lists, return_inverse=True)
            bits = lambda part: looked[part][:, there >> 3] >> (7 - (there & 7)) & 1 > 0
            asking = np.concatenate([np.zeros(0, np.int64), *[a + np.flatnonzero(bits(slice(a, a + PROBED)).any(1)) for a in range(0, len(ids), PROBED)]])
            for a in range(0, len(asking), ASKED):
                some = asking[a : a + ASKED]
                s = (q[some] @ centroids[there].T)[:, at]
                for j, (x, book) in enumerate(zip(_strips(q[some]), books)):
                    s += (x @ book.T)[:, codes[:, j]]
                s[~bits(some)[:, at]] = -np.inf
                n = min(keep, len(own))
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                scores = np.take_along_axis(s, top, 1).ravel()
                mine = np.isfinite(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[some], n)[mine]), pa.array(own[top].ravel()[mine]), pa.array(lists[top].ravel()[mine]), pa.array(scores[mine])], ["query_id", "vec_id", "list", "near"]
                )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, *_ = shared.value
        by_id = np.argsort(ids, kind="stable")
        for batch in batches:
            if batch.num_rows:
                at = by_id[np.searchsorted(ids[by_id], batch["query_id"].to_numpy())]
                s = np.round(np.einsum("ij,ij->i", q[at], _unit(_matrix(batch["embedding"]))), 9)
                yield pa.RecordBatch.from_arrays([batch["query_id"], batch["vec_id"], pa.array(s)], ["query_id", "vec_id", "score"])

    codes = lists_read(table(spark, folder, "codes"), model, union).select("list", "vec_id", "code")
    close = codes.mapInArrow(approximate, "query_id long, vec_id long, list int, near double")
    best = W.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    wanted = close.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep).select("query_id", "vec_id", "list")
    vectors = lists_read(table(spark, folder, "vectors"), model, union).select("list", "vec_id", "embedding")
    scored = vectors.join(wanted, ["list", "vec_id"]).select("query_id", "vec_id", "embedding").mapInArrow(exact, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k), shared


def ann(queries: DataFrame, vectors: DataFrame, k: int = 10, lists: int | None = None, visit: float = VISIT) -> DataFrame:
    """Approximate top ``k`` of each query: an index of all vectors in the shared folder, then a search in it."""
    return search(vectors.sparkSession, build(vectors, lists=lists), queries, k, visit)
