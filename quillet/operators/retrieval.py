"""Retrieval for many queries at once: legs, scope, reranking, compression, context (RET-*).

The full-text and the 3-gram leg are joins with a written index (``postings``), the dense leg
scans the vectors for bounded blocks of queries.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.folding import normalize_for_matching, sentences
from ..functions.text import estimate_tokens
from . import postings
from . import vectors as V
from .blocks import cut
from .chunking import count, hashed_all

SIMILAR = postings.SIMILAR


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def trigrams(text: str | None) -> set[str]:
    """3-grams of each word with two blanks before and one after."""
    return {f"  {w} "[k : k + 3] for w in terms(text) for k in range(len(w) + 1)}


def cover_density(places: dict[str, list[int]]) -> float:
    """0.1 / (1 + words between) over the shortest runs that hold every term."""
    entries = sorted((p, t) for t, ps in places.items() for p in ps)
    held: Counter[str] = Counter()
    total, a = 0.0, 0
    for b, (place, term) in enumerate(entries):
        held[term] += 1
        if len(held) < len(places):
            continue
        while held[entries[a][1]] > 1:
            held[entries[a][1]] -= 1
            a += 1
        total += 0.1 / (1 + (place - entries[a][0]) - (b - a))
        del held[entries[a][1]]
        a += 1
    return total


def _indexed(chunks: DataFrame | str, *legs: str) -> str:
    """The folder of an index, or of a new one for the ``legs`` over chunks (vec_id, text)."""
    return chunks if isinstance(chunks, str) else postings.build(chunks.select("vec_id", "text"), legs=legs)


def _density(entries: list) -> float:
    places: dict[str, list[int]] = defaultdict(list)
    for x in entries:
        places[x["term"]].append(x["place"])
    return cover_density(places)


def lexical_search(queries: DataFrame, chunks: DataFrame | str, n: int = 50, within: DataFrame | None = None) -> DataFrame:
    """Chunks that hold every word of a query, by cover density, ties by id (RET-1).

    ``chunks`` is (vec_id, text), or the folder of a ``postings`` index over them; ``within`` (vec_id) bounds the search.
    """
    return postings.lexical(queries, _indexed(chunks, "words"), postings.per_row(_density), n, within)


def trigram_search(queries: DataFrame, chunks: DataFrame | str, n: int = 50, least: float = SIMILAR, within: DataFrame | None = None) -> DataFrame:
    """Chunks whose share of common 3-grams passes the limit (RET-2)."""
    return postings.similar(queries, _indexed(chunks, "grams"), n, least, within)


def lexical_leg(queries: DataFrame, chunks: DataFrame | str, n: int = 50, scope: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """The full-text leg, and the trigram leg for queries it finds nothing for, then the ``scope`` (vec_id) of documents and day (RET-3).

    The scope comes last, so a query whose hits are all out of scope does not fall back; ``within`` comes first.
    """
    index = _indexed(chunks, "words", "grams")
    found = cut(lexical_search(queries, index, n, within))
    missing = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    both = found.unionByName(trigram_search(missing, index, n, within=within))
    return both if scope is None else both.join(scope.select("vec_id"), "vec_id", "left_semi")


def effective_on(day: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Within inclusive bounds; a null bound is open (DOC-5)."""
    return (F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) >= day))


def document_scope(chunks: DataFrame, docs: DataFrame, on: Column | None = None) -> DataFrame:
    """Chunks of documents that are neither superseded nor archived, and in effect on the day (RET-5)."""
    live = docs.filter(~F.coalesce(F.col("status").isin("SUPERSEDED", "ARCHIVED"), F.lit(False)))
    live = live if on is None else live.filter(effective_on(on))
    return chunks.join(live.select("doc_id").distinct(), "doc_id", "left_semi")


def rerank(candidates: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """Adds rerank_score: 0.7 x share of the query's words in the text + 0.3 for the phrase as a whole, on folded text (RET-7)."""
    folded = candidates.withColumns({"_q": normalize_for_matching(query), "_t": normalize_for_matching(text)})
    asked = F.array_distinct(F.split("_q", " "))
    coverage = F.size(F.array_intersect(asked, F.split("_t", " "))) / F.size(asked)
    phrase = F.when(F.contains("_t", "_q"), 0.3).otherwise(0.0)
    return folded.withColumn("rerank_score", F.when(F.col("_q") == "", 0.0).otherwise(F.least(F.lit(1.0), 0.7 * coverage + phrase))).drop("_q", "_t")


def finalize(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Final score from the best kind there is, and rank; then the threshold (RET-8)."""
    there = [c for c in ("rerank_score", "fused", "dense_score", "lexical_score") if c in df.columns]
    scored = df.withColumn("final_score", F.coalesce(*there))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("final_score"), "vec_id"))
    return scored.withColumn("final_rank", rank).filter(F.col("final_score") >= threshold)


def compress(query: Column, text: Column, budget: int, top_k: int) -> Column:
    """The sentences with most of the query's words that fit max(32, budget / top_k) tokens, in reading order (RET-9)."""
    room = max(32, budget // max(1, top_k))

    def one(q: str | None, t: str | None) -> str | None:
        if t is None or count(t) <= room:
            return t
        asked, parts = set(terms(q)), sentences(t)
        order = sorted(range(len(parts)), key=lambda k: (-len(asked & set(terms(parts[k]))), k))
        kept: list[int] = []
        for k in order:
            if count(" ".join(parts[j] for j in sorted([*kept, k]))) <= room:
                kept.append(k)
        return " ".join(parts[k] for k in sorted(kept or order[:1]))

    @F.pandas_udf("string")
    def run(qs: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([one(q, t) for q, t in zip(qs, ts, strict=True)])

    return run(query, text)


def attach_citations(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Label of each chunk's place, once per (query, document, section), numbered in rank order (RET-11)."""
    label = F.concat_ws(", ", "title", F.concat(F.lit("v"), F.col("version").cast("string")), F.when(F.col("section") != "", F.col("section")), F.concat(F.lit("p. "), F.col("page").cast("string")))
    cited = ranked.join(docs.select("doc_id", "title", "version"), "doc_id").withColumn("label", label)
    first = W.partitionBy("query_id", "doc_id", "section").orderBy("final_rank")
    once = cited.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return once.withColumn("citation", F.row_number().over(W.partitionBy("query_id").orderBy("final_rank"))).select("query_id", "citation", "doc_id", "section", "label")


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The results of each query that fit its budget of tokens in rank order; the first stays, misfits are passed over (RET-10)."""
    sized = ranked.select("query_id", "vec_id", F.col("final_rank").alias("rank"), estimate_tokens(F.col("text")).cast("long").alias("tokens"))
    kept = V.packed(sized, budget).select("query_id", F.explode("p.ids").alias("vec_id"))
    return ranked.join(kept, ["query_id", "vec_id"], "left_semi")


def build_context(ranked: DataFrame, budget: int = 4_000) -> DataFrame:
    """Per query the text '[n] chunk', its tokens and chunks; what does not fit is passed over, the first stays (RET-10, RET-12).

    A query's chunks are bounded by the legs' top n, so they meet in one group.
    """
    lines = F.sort_array(F.collect_list(F.struct("final_rank", "text", estimate_tokens(F.col("text")).alias("tokens"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("cut"), F.lit("").alias("context"))

    def add(s: Column, x: Column) -> Column:
        fits = (s["n"] == 0) | (s["used"] + x["tokens"] <= budget)
        line = F.concat(F.when(s["n"] > 0, "\n\n").otherwise(""), F.lit("["), (s["n"] + 1).cast("string"), F.lit("] "), x["text"])
        more = F.struct((s["used"] + x["tokens"]).alias("used"), (s["n"] + 1).alias("n"), s["cut"].alias("cut"), F.concat(s["context"], line).alias("context"))
        return F.when(fits, more).otherwise(F.struct(s["used"].alias("used"), s["n"].alias("n"), F.lit(True).alias("cut"), s["context"].alias("context")))

    folded = ranked.groupBy("query_id").agg(F.aggregate(lines, start, add).alias("s"))
    return folded.select("query_id", F.col("s.used").alias("tokens"), F.col("s.n").alias("chunks"), F.col("s.cut").alias("truncated"), "s.context")


def embed_hash(df: DataFrame, col: str = "text", dims: int = 64) -> DataFrame:
    """Adds the hashed vector of the text (EMB-1)."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([v.tolist() for v in hashed_all(batch.tolist(), dims)], batch.index, object)

    return df.withColumn("embedding", run(col))


def embed_distinct(df: DataFrame, col: str = "text", dims: int = 64) -> DataFrame:
    """Each different text embedded once, then given to all its rows (EMB-9)."""
    keyed = df.withColumn("_key", F.sha2(F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8"), 256))
    once = embed_hash(keyed.groupBy("_key").agg(F.first(col).alias(col)), col, dims).select("_key", "embedding")
    return keyed.join(once, "_key").drop("_key")


def prepare(chunks: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Index and embed (vec_id, text) once, for any number of ``retrieve``: the postings' folder and the written vectors."""
    spark = chunks.sparkSession
    legs = postings.build(chunks.select("vec_id", "text"), folder)
    embed_distinct(chunks.select("vec_id", "text")).select("vec_id", "embedding").write.parquet(f"{legs}/vectors")
    return legs, spark.read.parquet(f"{legs}/vectors")


def retrieve(
    queries: DataFrame, chunks: DataFrame, top_k: int = 10, n: int = 50, budget: int = 4_000, threshold: float = 0.0, docs: DataFrame | None = None, on: Column | None = None,
    index: tuple[str, DataFrame] | None = None,
) -> DataFrame:
    """Lexical and dense legs, fused, reranked, cut to ``top_k``, compressed, ranked and packed to the budget (RET-13).

    ``chunks`` is (vec_id, text, ...), with doc_id where ``docs`` and a day bound the scope.  ``index``, from
    ``prepare``, serves many calls: the folder of the postings and the table of the chunks' vectors.
    """
    within = None if docs is None else document_scope(chunks.select("vec_id", "doc_id"), docs, on).select("vec_id")
    if index is None:
        chunks = chunks if within is None else chunks.join(within, "vec_id", "left_semi")
        legs, vectors, within = postings.build(chunks.select("vec_id", "text")), embed_hash(chunks.select("vec_id", "text")), None
    else:
        legs, vectors = index
        vectors = vectors if within is None else vectors.join(within, "vec_id", "left_semi")
    lexical = lexical_leg(queries, legs, n, within=within).select("query_id", "vec_id", "rank")
    asked = embed_hash(queries.select("query_id", F.col("query").alias("text"))).select("query_id", "embedding")
    dense = V.knn(asked, vectors.select("vec_id", "embedding"), n).select("query_id", "vec_id", "rank")
    fused = V.rrf({"lexical": lexical, "dense": dense}, {"lexical": 0.4, "dense": 0.6})
    met = fused.select("query_id", "vec_id", "fused").join(chunks, "vec_id").join(queries.select("query_id", "query"), "query_id")
    best = finalize(rerank(met), threshold).filter(F.col("final_rank") <= top_k)
    return within_budget(best.withColumn("text", compress(F.col("query"), F.col("text"), budget, top_k)), budget)
