"""Vector functions, exact neighbours and rank fusion (EMB-*, RET-*)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import in_blocks

MAX_QUERIES = 20_000
MAX_K, MAX_OFFSET = 500, 10_000


def dot(a: Column, b: Column) -> Column:
    """Dot product; an error for vectors of unequal width (EMB-3)."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unequal width"))))


def l2_norm(v: Column) -> Column:
    """Length of a vector (EMB-2)."""
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit vector; one shorter than 1e-12 stays (EMB-2)."""
    n = l2_norm(v)
    return F.when(n < 1e-12, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, clamped; 0 with a zero vector (EMB-3)."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine (EMB-3)."""
    return 1 - cosine(a, b)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance (EMB-3)."""
    apart = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(dot(a, b).isNotNull(), l2_norm(apart))


def score_from_distance(d: Column, metric: str) -> Column:
    """Distance to a score between 0 and 1 (EMB-4)."""
    raw = {"cosine": 1 - d, "inner_product": -d, "euclidean": 1 - d * d / 2}[metric]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def centroids(vectors: DataFrame, key: str = "label") -> DataFrame:
    """Mean vector per group (EMB-5)."""
    flat = vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def knn(
    queries: DataFrame, vectors: DataFrame, k: int = 10, *, within: tuple[str, ...] = (), where: Column | None = None, least: float | None = None, offset: int = 0
) -> DataFrame:
    """Exact top ``k`` by cosine for each query (query_id, embedding) (EMB-6).

    ``within`` names columns of both sides, as tenant and spec, that must agree; ``where``
    filters the vectors before they are scored; ``least`` is a score's lower limit;
    ``offset`` passes over so many of the best.  Ties go by id.

    The query set is broadcast, in blocks of at most ``MAX_QUERIES``.  Each Arrow batch
    keeps its own best per query, so the shuffle carries k + offset rows per query and batch.
    """
    if not 0 < k <= MAX_K or not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"k is from 1 to {MAX_K}, offset from 0 to {MAX_OFFSET}")
    asked = queries if within else queries.toDF("query_id", "embedding")
    asked = asked.select("query_id", "embedding", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in within]).alias("_part"))
    held = (vectors if where is None else vectors.filter(where)).select(
        "vec_id", "embedding", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in within]).alias("_part")
    )
    found = in_blocks(asked, MAX_QUERIES, lambda rows: _knn(rows, held, k + offset))
    found = found if least is None else found.filter(F.col("score") >= least)
    return found if not offset else found.filter(F.col("rank") > offset).withColumn("rank", F.col("rank") - offset)


def _knn(rows: list[Row], vectors: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    ids, parts = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, unit(np.array([r[1] for r in rows], np.float64)), parts))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, parts = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own, part = batch["vec_id"].to_numpy(), np.array(batch["_part"].to_pylist())
            m = unit(np.array(batch["embedding"].to_pylist(), np.float64))
            for a in range(0, len(ids), 512):
                s = np.where(parts[a : a + 512, None] == part[None, :], q[a : a + 512] @ m.T, -2.0)
                # Ties at the cut are decided by id, as in the end.
                top = np.lexsort((np.broadcast_to(own, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                scores = np.round(np.take_along_axis(s, top, 1), 9).ravel()
                mine = scores >= -1.5  # others are of another part
                columns = (np.repeat(ids[a : a + 512], top.shape[1])[mine], own[top].ravel()[mine], scores[mine])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    found = vectors.mapInArrow(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k), shared


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours found, 1 where there are none (EMB-8)."""
    hit = approx.select("query_id", "vec_id", F.lit(1.0).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def min_max(ranked: DataFrame) -> DataFrame:
    """Scores of each query stretched to 0..1; equal scores give 1 (RET-4)."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("scaled", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def rrf(legs: dict[str, DataFrame], weights: dict[str, float], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of legs (query_id, vec_id, rank), over the best that legs with rows allow (RET-6)."""
    # Joined leg by leg rather than stacked: the legs are already partitioned by query, and a join keeps them aligned.
    rows = None
    for name, leg in legs.items():
        one = leg.select("query_id", "vec_id", (F.lit(weights[name]) / (k + F.col("rank"))).alias(f"_{name}"))
        rows = one if rows is None else rows.join(one, ["query_id", "vec_id"], "full_outer")
    query = W.partitionBy("query_id")
    raw, limit = F.lit(0.0), F.lit(0.0)
    for name in legs:
        raw = raw + F.coalesce(F.col(f"_{name}"), F.lit(0.0))
        limit = limit + F.coalesce(F.max(F.when(F.col(f"_{name}").isNotNull(), weights[name] / (k + 1))).over(query), F.lit(0.0))
    scored = rows.select("query_id", "vec_id", F.least(F.lit(1.0), raw / limit).alias("fused"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), "vec_id")))


def packed(ranked: DataFrame, budget: int) -> DataFrame:
    """query_id, p (used tokens and ids of what fits) and n of (query_id, vec_id, rank, tokens)."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "tokens")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("ids"))
    fits = lambda s, x: (F.size(s["ids"]) == 0) | (s["used"] + x["tokens"] <= budget)
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x["tokens"]).alias("used"), F.array_append(s["ids"], x["vec_id"]).alias("ids"))).otherwise(s)
    return ranked.groupBy("query_id").agg(F.aggregate(rows, start, step).alias("p"), F.count("*").alias("n"))


def pack_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Results that fit the budget in rank order; the first always stays, misfits are skipped (RET-10)."""
    return packed(ranked, budget).select("query_id", F.col("p.used").alias("used"), F.array_join(F.transform("p.ids", lambda x: x.cast("string")), ",").alias("kept"), (F.size("p.ids") < F.col("n")).alias("truncated"))
