"""Document versions, boilerplate and chunks (DOC-*, TXT-10, CHK-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import normalize_for_matching, normalize_text
from ..functions.text import estimate_tokens, strip_page_numbers, with_language
from .blocks import numbered


def dedup_documents(docs: DataFrame, keys: tuple[str, ...] = ("lang",), existing: DataFrame | None = None) -> DataFrame:
    """First document of each content per tenant; repeats point at it (DOC-1).

    ``existing`` (keys, checksum, doc_id) is the store: what it holds is first.
    """
    digest = docs.withColumn("checksum", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    first = digest.groupBy(*keys, "checksum").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    if existing is not None:
        stored = existing.groupBy(*keys, "checksum").agg(F.min("doc_id").alias("_stored"))
        first = first.join(stored, [*keys, "checksum"], "left").withColumn("first_id", F.coalesce("_stored", "first_id")).drop("_stored")
    return digest.select("doc_id", *keys, "checksum").join(first, [*keys, "checksum"]).withColumn(
        "status", F.when(F.col("doc_id") == F.col("first_id"), "INDEXED").otherwise("SKIPPED_DUPLICATE")
    )


def assign_versions(docs: DataFrame) -> DataFrame:
    """Version per (tenant, title) and the chain of what supersedes what (DOC-2)."""
    rows = numbered(docs.select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], "doc_id")
    names = {"_place": "version", "_before": "supersedes_id", "_after": "superseded_by"}
    out = rows.withColumn("_place", F.col("_place").cast("int")).withColumnsRenamed(names).drop("_total")
    return out.withColumn("status", F.when(F.col("superseded_by").isNull(), "INDEXED").otherwise("SUPERSEDED"))


def boilerplate_lines(sections: DataFrame, share: float = 0.6, least: int = 4, width: int = 200) -> DataFrame:
    """(doc_id, line): lines, folded for matching, in most sections of a document (TXT-10)."""
    counts = sections.groupBy("doc_id").agg(F.countDistinct("section").alias("n")).filter(F.col("n") >= least)
    lines = sections.select("doc_id", "section", F.explode(F.split("text", "\n")).alias("_line"))
    short = lines.filter(F.length(F.trim("_line")).between(1, width)).withColumn("line", normalize_for_matching("_line")).filter("line <> ''")
    found = short.groupBy("doc_id", "line").agg(F.countDistinct("section").alias("sections"))
    return found.join(counts, "doc_id").filter(F.col("sections") >= F.ceil(share * F.col("n"))).select("doc_id", "line", "sections")


def paragraph_chunks(docs: DataFrame) -> DataFrame:
    """Chunks at blank lines with index, checksum and token estimate (CHK-8 over TXT-3)."""
    parts = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", r"\n"), lambda p: F.trim(p)), lambda p: p != "")).alias("chunk_index", "chunk"))
    return parts.select(
        "doc_id", "chunk_index", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), "chunk"), 256).alias("chunk_id"),
        F.length("chunk").alias("n_chars"), estimate_tokens(F.col("chunk")).alias("tokens"), "chunk",
    )


def reassemble(chunks: DataFrame) -> DataFrame:
    """Document texts from their chunks in order (DOC-11)."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk"]), "\n").alias("text"))


def count_by_spec(vectors: DataFrame) -> DataFrame:
    """Vectors per tenant and spec (DOC-7)."""
    return vectors.groupBy("tenant", "spec").agg(F.count("*").alias("vectors"))


def chunks_missing_embedding(chunks: DataFrame, vectors: DataFrame, spec: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks (chunk_id, created_at, ...) without a vector, or without one of a spec, the oldest first (DOC-8)."""
    have = vectors if spec is None else vectors.filter(F.col("spec") == spec)
    out = chunks.join(have.select("chunk_id"), "chunk_id", "left_anti")
    return out if limit is None else out.orderBy("created_at", "chunk_id").limit(limit)


def check_batch(batch: DataFrame, keys: tuple[str, ...] = ("tenant", "chunk_id", "spec")) -> DataFrame:
    """(fault, n): what an upsert must not hold: keys that repeat, and more than one spec (SRC-9)."""
    repeated = batch.groupBy(*keys).count().filter("count > 1").agg(F.lit("REPEATED_KEY").alias("fault"), F.count("*").alias("n"))
    specs = batch.agg(F.lit("SEVERAL_SPECS").alias("fault"), (F.countDistinct("spec") - 1).alias("n"))
    return repeated.unionByName(specs).filter("n > 0")


def upsert_embeddings(existing: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("tenant", "chunk_id", "spec")) -> DataFrame:
    """Rows of ``batch`` replace those of equal key, others are added (SRC-9); ``check_batch`` says whether a batch may be used."""
    return existing.join(batch.select(*keys), list(keys), "left_anti").select(existing.columns).unionByName(batch.select(existing.columns))


def delete_by_document(vectors: DataFrame, ids: DataFrame, spec: str | None = None) -> DataFrame:
    """Vectors without those of the given documents, of one spec or all (SRC-10)."""
    keys = [c for c in ("tenant", "doc_id") if c in vectors.columns and c in ids.columns]
    gone = ids.select(*keys).distinct()
    if spec is None:
        return vectors.join(gone, keys, "left_anti").select(vectors.columns)
    return vectors.join(gone.withColumn("spec", F.lit(spec)), [*keys, "spec"], "left_anti").select(vectors.columns)


def document_language(sections: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, language): the language of most characters over sections long enough, else that of the whole text (TXT-8)."""

    def detected(df: DataFrame) -> DataFrame:
        return with_language(df).select("doc_id", "language", F.length("text").alias("size"))

    # Nulls are passed over in the aggregate: a filter on the language would repeat its whole expression below, for each of its uses.
    votes = detected(sections.filter(F.length("text") >= least)).groupBy("doc_id", "language").agg(F.sum("size").alias("size"))
    voted = votes.groupBy("doc_id").agg(F.max_by("language", F.when(F.col("language").isNotNull(), F.struct("size", "language"))).alias("voted"))
    # A document's sections are its own text again, so a group is no larger than one document.
    whole = sections.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n").alias("text"))
    both = detected(whole).join(voted, "doc_id", "left")
    return both.select("doc_id", F.coalesce("voted", "language").alias("language"))


def strip_boilerplate(sections: DataFrame) -> DataFrame:
    """Sections without the lines that most of their document's sections share (TXT-10)."""
    gone = boilerplate_lines(sections).select("doc_id", F.col("line").alias("_key"))
    lines = sections.select("doc_id", "section", F.posexplode(F.split("text", "\n", -1)).alias("_at", "_line")).withColumn("_key", F.when(F.length(F.trim("_line")) <= 200, normalize_for_matching("_line")))
    left = lines.join(gone, ["doc_id", "_key"], "left_anti").groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("_at", "_line"))).alias("_l"))
    return left.select("doc_id", "section", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("text"))


def clean_sections(sections: DataFrame) -> DataFrame:
    """Page numbers, then boilerplate, then typography; sections left empty are dropped (TXT-11)."""
    bare = sections.select("doc_id", "section", strip_page_numbers(F.col("text")).alias("text"))
    return strip_boilerplate(bare).withColumn("text", normalize_text("text")).filter(F.col("text") != "")
