"""Document search, filters, profiles and ledgers, and checks of vectors (DOC-3, 4, 6, 9, 10; EMB-10, 11; POL-6, 15, 18, 20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .claims import page
from .retrieval import effective_on

HIDDEN = ("SUPERSEDED", "ARCHIVED")
OPERATORS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "contains", "exists")


def search_documents(docs: DataFrame, *, statuses: list[str] | None = None, on: Column | None = None, offset: int = 0, limit: int | None = None, **equal: str) -> DataFrame:
    """Documents by status, columns and day in effect; superseded and archived ones only when asked for; newest first (DOC-4)."""
    out = docs.filter(F.col("status").isin(*statuses)) if statuses is not None else docs.filter(~F.coalesce(F.col("status").isin(*HIDDEN), F.lit(False)))
    for name, value in equal.items():
        out = out.filter(F.col(name) == value)
    out = out if on is None else out.filter(effective_on(on))
    return page(out, F.desc("created_at"), F.desc("doc_id"), offset=offset, limit=limit)


def assign_profile(docs: DataFrame, profiles: dict[str, tuple[str, str]], other: tuple[str, str]) -> DataFrame:
    """Chunk strategy and default category of the source type (DOC-6)."""
    pick = lambda k: F.coalesce(F.try_element_at(F.create_map(*[x for n, p in profiles.items() for x in (F.lit(n), F.lit(p[k]))]), F.col("source_type")), F.lit(other[k]))
    return docs.withColumn("strategy", pick(0)).withColumn("category", pick(1))


def ingestion_summary(runs: DataFrame) -> DataFrame:
    """Runs per status and whether it counts as success; skipped duplicates do (DOC-9)."""
    good = F.col("status").isin("INDEXED", "SKIPPED_DUPLICATE")
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.max("finished_at").alias("last")).withColumn("succeeded", good)


def recent_runs(runs: DataFrame, tenant: str, *, status: str | None = None, doc_id: int | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A tenant's ingestion runs, of one status or one document, newest first (DOC-9)."""
    out = runs.filter(F.col("tenant") == tenant)
    out = out if status is None else out.filter(F.col("status") == status)
    out = out if doc_id is None else out.filter(F.col("doc_id") == doc_id)
    return page(out, F.desc("started_at"), F.asc("run_id"), offset=offset, limit=limit)


def runs_of_documents(runs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest runs of each document of each tenant, numbered (DOC-9)."""
    along = W.partitionBy("tenant", "doc_id").orderBy(F.desc("started_at"), "run_id")
    return runs.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= n)


def compile_filters(filters: list[tuple[str, str, object]], fields: dict[str, str], lists: tuple[str, ...] = (), extra: str | None = None) -> Column:
    """One condition from (field, operator, value) (DOC-10).

    ``fields`` names the columns that may be asked for; ``extra.*`` reads a JSON column.
    ne and nin keep nulls, the others drop them; an unknown field or operator and an
    empty list are errors.
    """
    out = F.lit(True)
    for field, op, value in filters:
        if field.startswith("extra.") and extra:
            col = F.get_json_object(extra, f"$.{field[6:]}")
        elif field in fields:
            col = F.col(fields[field])
        else:
            raise ValueError(f"unknown field {field}")
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        if op in ("in", "nin") and not value:
            raise ValueError(f"empty list for {field}")
        if op == "contains":
            test = F.array_contains(col, value) if field in lists else F.contains(F.lower(col), F.lit(str(value).lower()))
        else:
            test = {
                "eq": lambda c, v: c == v, "ne": lambda c, v: c.isNull() | (c != v), "in": lambda c, v: c.isin(*v), "nin": lambda c, v: c.isNull() | ~c.isin(*v),
                "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
                "exists": lambda c, v: c.isNotNull() if v else c.isNull(),
            }[op](col, value)
        out = out & F.coalesce(test, F.lit(False))
    return out


def check_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors with a wrong width, an empty spec, another length than 1, or an id that repeats (EMB-10)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    repeats = vectors.groupBy("vec_id", "spec").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_twice", F.lit(True)).drop("_n")
    met = vectors.join(repeats, ["vec_id", "spec"], "left")
    faults = F.array_compact(F.array(
        F.when(F.size("embedding") != dims, "WIDTH"), F.when(F.coalesce(F.trim("spec"), F.lit("")) == "", "NO_SPEC"),
        F.when(F.abs(norm - 1) > 1e-4, "NOT_UNIT"), F.when(F.col("_twice"), "REPEATED"),
    ))
    return met.select("vec_id", "spec", F.array_join(faults, ",").alias("faults")).filter("faults <> ''")


def usage_summary(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals per provider and model, with cost by unit price; no price costs nothing (EMB-11)."""
    totals = usage.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("latency_ms").alias("latency_ms"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return totals.join(prices.select("provider", "model", "unit_price"), ["provider", "model"], "left").withColumn("cost", F.col("tokens") * F.coalesce("unit_price", F.lit(0.0))).drop("unit_price")


def active_by_kind(entries: DataFrame) -> DataFrame:
    """Active registry entries per kind, names in order (POL-6)."""
    return entries.filter("is_active").groupBy("kind").agg(F.count("*").alias("entries"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def pages_from_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, page, section, heading_path, text) as page texts, unpaged ones as one page at the end, with a section hint (POL-15)."""
    rows = F.sort_array(F.collect_list(F.struct("chunk_index", "text", F.when(F.trim("section") != "", F.col("section")).alias("section"), "heading_path")))
    pages = chunks.groupBy("doc_id", "page").agg(rows.alias("r"))
    named = F.try_element_at(F.filter(F.transform("r", lambda x: x["section"]), lambda s: s.isNotNull()), F.lit(1))
    return pages.select(
        "doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy(F.asc_nulls_last("page"))).alias("place"), "page",
        F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"), F.coalesce(named, F.try_element_at("r", F.lit(1))["heading_path"]).alias("hint"),
    )


def dedup_candidates(rules: DataFrame, width: int = 160) -> DataFrame:
    """Of a page's rules with one name and source beginning, the longest stays at the first's place (POL-18)."""
    key = ["doc_id", "page", F.lower(F.trim("name")), F.substring("source", 1, width)]
    w = W.partitionBy(*key)
    ranked = rules.withColumn("_n", F.row_number().over(w.orderBy(F.desc(F.length("body")), "position"))).withColumn("first_place", F.min("position").over(w))
    return ranked.filter("_n = 1").drop("_n")


def review_candidates(rules: DataFrame, sure: float = 0.7) -> DataFrame:
    """Whether a rule needs review, and its special rules with exclusions and documents folded in, once each whatever the case (POL-20)."""
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("special_rules", none), F.transform(F.coalesce("exclusions", none), lambda x: F.concat(F.lit("Excluded: "), x)), F.transform(F.coalesce("documents", none), lambda x: F.concat(F.lit("Document: "), x)))
    once = F.aggregate(every, none, lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(F.trim(y)) == F.lower(F.trim(x))), seen).otherwise(F.array_append(seen, x)))
    review = (F.size(F.coalesce("notes", none)) > 0) | (F.coalesce(F.trim("source"), F.lit("")) == "") | (F.coalesce("confidence", F.lit(0.0)) < sure)
    return rules.withColumn("needs_review", review).withColumn("special_rules", once)
