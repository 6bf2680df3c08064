"""Kinds of documents, decisions to remember, and retrieval within a scope (TXT-13, RET-14, RET-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval as R
from .library import compile_filters

#: Words and phrases by source type; earlier types win ties.
KEYWORDS = {
    "TRAVEL_POLICY": ("travel policy", "airfare", "per diem", "mileage", "flight class", "layover", "business travel", "travel expense"),
    "MEDICAL_POLICY": ("medical policy", "health insurance", "prescription", "co-pay", "deductible", "medical claim", "physician"),
    "FINANCE_POLICY": ("finance policy", "general ledger", "cost centre", "cost center", "budget approval", "expense report", "accounts payable"),
    "COUNTRY_POLICY": ("country policy", "local regulation", "statutory requirement", "jurisdiction", "country-specific"),
    "EMPLOYEE_HANDBOOK": ("employee handbook", "code of conduct", "onboarding", "probation period", "performance review", "leave policy"),
    "VENDOR_CONTRACT": ("vendor contract", "master service agreement", "statement of work", "termination clause", "governing law", "indemnification"),
    "VENDOR_MANUAL": ("vendor manual", "user guide", "installation instructions", "product manual", "troubleshooting"),
    "HISTORICAL_CLAIM": ("claim number", "claim status", "reimbursement amount", "approved amount", "claim submitted"),
    "HISTORICAL_DECISION": ("decision rationale", "approved by", "rejected by", "escalated to", "final decision"),
    "REVIEWER_NOTE": ("reviewer note", "internal note", "flagged for review", "manager comment", "review comment"),
    "FRAUD_INVESTIGATION": ("fraud investigation", "suspicious activity", "duplicate submission", "fraud alert", "investigation findings"),
    "TAX_RULE": ("tax rule", "tax rate", "withholding tax", "value added tax", "vat rate", "taxable benefit"),
    "GOVERNMENT_GUIDELINE": ("government guideline", "regulatory guidance", "statutory guideline", "official gazette", "ministry of"),
    "RECEIPT": ("receipt", "subtotal", "total due", "thank you for your purchase", "cashier"),
    "INVOICE": ("invoice number", "invoice date", "bill to", "payment terms", "remit to", "amount due"),
    "TRAINING_DOCUMENT": ("training material", "learning objective", "course outline", "module 1", "quiz"),
    "FAQ": ("frequently asked questions", "faq", "q:", "a:"),
    "POLICY": ("policy", "shall", "must comply", "effective date", "policy owner"),
}
#: Hits per 1,000 words that a type needs; what a status is remembered as; and the source type of each kind.
LEAST_SCORE = 0.5
STATUS_KIND = {"Manager_Review": "REVIEW", "Finance_Review": "REVIEW", "Auto_Approved": "APPROVAL", "Approved": "APPROVAL", "Reimbursed": "APPROVAL", "Rejected": "REJECTION"}
KIND_SOURCE = {
    "CLAIM": "HISTORICAL_CLAIM", "REVIEW": "HISTORICAL_DECISION", "APPROVAL": "HISTORICAL_DECISION", "REJECTION": "HISTORICAL_DECISION",
    "COMMENT": "REVIEWER_NOTE", "FRAUD_FINDING": "FRAUD_INVESTIGATION", "AI_EXPLANATION": "HISTORICAL_DECISION",
}
MEMORY_TYPES = tuple(sorted(set(KIND_SOURCE.values())))
VENDOR_TYPES = ("VENDOR_CONTRACT", "VENDOR_MANUAL")
#: Chunk settings for remembered decisions (CHK-1): tokens, overlap, least.
MEMORY_CHUNKS = (256, 32, 1)


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def source_type_hits(text: Column) -> Column:
    """(type, hits) of every type with a hit, in the table's order."""
    low = F.lower(text)
    count = lambda w: F.when(F.contains(low, F.lit(w)), (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).otherwise(0)
    rows = [F.struct(F.lit(name).alias("type"), sum((count(w) for w in words), F.lit(0)).cast("long").alias("hits")) for name, words in KEYWORDS.items()]
    return F.filter(F.array(*rows), lambda r: r["hits"] > 0)


def classify_source_type(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds hits, type_score (of the leading type, per 1,000 words) and source_type, OTHER below the least score (TXT-13)."""
    words = F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+")), F.lit(1))
    hit = df.withColumns({"hits": source_type_hits(F.coalesce(text, F.lit(""))), "_words": words})
    top = F.array_max(F.transform("hits", lambda h: h["hits"]))
    lead = F.try_element_at(F.filter("hits", lambda h: h["hits"] == top), F.lit(1))
    scored = hit.withColumns({"type_score": F.coalesce(top * 1000 / F.col("_words"), F.lit(0.0)), "_lead": lead["type"]})
    kind = F.when(F.col("type_score") >= LEAST_SCORE, F.col("_lead")).otherwise("OTHER")
    return scored.withColumn("source_type", kind).drop("_words", "_lead")


def decision_memory(history: DataFrame, claims: DataFrame) -> DataFrame:
    """One document per move to a status worth remembering (RET-15).

    ``history`` has event_id, claim_id, from_status, to_status, actor_role; ``claims`` has
    claim_id, categories (list), currency, total_usd, item_count.  The documents are
    ready for CHK-1 with ``MEMORY_CHUNKS``; notes are left out on purpose.
    """
    kept = history.withColumn("kind", F.try_element_at(_table(STATUS_KIND), F.col("to_status"))).filter("kind IS NOT NULL")
    met = kept.join(claims.select("claim_id", "categories", "currency", "total_usd", "item_count"), "claim_id")
    summary = F.format_string(
        "Claim %s (%s, %s %s across %s item(s)): %s by %s. Status %s -> %s.",
        F.col("claim_id").cast("string"), F.array_join(F.array_sort(F.array_distinct("categories")), ", "), "currency", F.col("total_usd").cast("decimal(18,2)").cast("string"),
        F.col("item_count").cast("string"), F.lower("kind"), "actor_role", F.coalesce("from_status", F.lit("Draft")), "to_status",
    )
    return met.select(
        F.concat_ws("-", F.lower("kind"), F.col("claim_id").cast("string"), F.col("event_id").cast("string")).alias("title"),
        "event_id", "claim_id", "kind", F.try_element_at(_table(KIND_SOURCE), F.col("kind")).alias("source_type"), summary.alias("text"),
    )


_FIELDS = {name: name for name in ("category", "country", "currency", "source_type")}


def retrieve_scoped(
    queries: DataFrame, chunks: DataFrame, docs: DataFrame, filters: list[tuple[str, str, object]] = (), on: Column | None = None, top_k: int = 8, budget: int = 4_000,
    index: tuple[str, DataFrame] | None = None,
) -> DataFrame:
    """Contexts of RET-13 over the chunks of documents within the filters and in effect on the day (RET-14).

    ``index`` (``retrieval.prepare``) over all chunks serves every call.
    """
    inside = docs.filter(compile_filters(list(filters), _FIELDS)) if filters else docs
    found = R.retrieve(queries, chunks, top_k, budget=budget, docs=inside, on=on, index=index)
    return R.build_context(found, budget)


def retrieve_policy(queries: DataFrame, chunks: DataFrame, docs: DataFrame, on: Column | None = None, source_types: tuple[str, ...] = (), top_k: int = 8, index: tuple[str, DataFrame] | None = None, **equal: str) -> DataFrame:
    """Answers to policy questions by category, country, currency, source types and day (RET-14)."""
    filters = [(name, "eq", value) for name, value in equal.items() if value]
    filters += [("source_type", "in", list(source_types))] if source_types else []
    return retrieve_scoped(queries, chunks, docs, filters, on, top_k, index=index)


def retrieve_similar(queries: DataFrame, chunks: DataFrame, docs: DataFrame, top_k: int = 5, index: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Earlier decisions like the claims asked about (RET-14)."""
    return retrieve_scoped(queries, chunks, docs, [("source_type", "in", list(MEMORY_TYPES))], top_k=top_k, index=index)


def retrieve_vendor(queries: DataFrame, chunks: DataFrame, docs: DataFrame, top_k: int = 5, index: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Contracts and manuals of the vendors asked about (RET-14)."""
    return retrieve_scoped(queries, chunks, docs, [("source_type", "in", list(VENDOR_TYPES))], top_k=top_k, index=index)
