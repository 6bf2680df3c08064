"""All registered queries of the audit and knowledge jobs with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import duplicates as U
from ..operators import fraud, lifecycle, policy
from ..operators import vectors as V
from ..sources import tables
from . import catalogue, claims, knowledge, library, oracle

Query = Callable[[SparkSession, str], DataFrame]


def audited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their policy report, fraud screen and route."""
    judged = policy.evaluate_expense_policy(tables.expense_items(spark, sf_dir), policy.seed_rules(spark))
    return lifecycle.route_items(fraud.screen_fraud(judged, tables.task_count(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims audit: one row per claim."""
    return lifecycle.roll_up_claims(audited_items(spark, sf_dir))


def src_01_expense_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.expense_items(spark, sf_dir)


def pol_02_rules_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.rules_as_of(tables.expense_items(spark, sf_dir), policy.seed_rules(spark)).select("item_id", "ruleset_date", "code", "age_limit")


def pol_07_check_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = policy.with_limits(policy.rules_as_of(tables.expense_items(spark, sf_dir), policy.typed_rules(policy.seed_rules(spark))))
    return f.select("item_id", "days", (F.col("days") > F.col("age_limit")).alias("over_age"))


def pol_08_check_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = policy.with_limits(policy.rules_as_of(tables.expense_items(spark, sf_dir), policy.typed_rules(policy.seed_rules(spark))))
    return f.select("item_id", "max_limit", "auto", (F.col("amount") > F.col("max_limit")).alias("over_max"), (F.col("amount") > F.col("auto")).alias("over_auto"))


def pol_12_policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also POL-9, POL-10 and POL-11: their checks are part of the report."""
    report = policy.evaluate_expense_policy(tables.expense_items(spark, sf_dir), policy.seed_rules(spark))
    checks = F.array_join(F.transform("checks", lambda c: F.concat(c["rule_id"], F.when(c["passed"], "+").otherwise("-"))), ",")
    return report.select("item_id", "policy_passed", "manual_review", "within_max", "within_auto", "max_limit", "days_since_expense", checks.alias("checks"))


def frd_07_screen_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FRD-1 to FRD-7."""
    s = fraud.screen_fraud(tables.expense_items(spark, sf_dir), tables.task_count(spark, sf_dir))
    return s.select("item_id", "risk_score", "risk_score_capped", "risk_level", "recommended_action", "is_flagged", F.array_join("flags", ",").alias("flags"))


def frd_08_claim_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud.claim_fraud(fraud.screen_fraud(tables.expense_items(spark, sf_dir), tables.task_count(spark, sf_dir)))


def lif_01_route_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited_items(spark, sf_dir).select("item_id", "route")


def lif_02_hold_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.hold_reasons(audited_items(spark, sf_dir), tables.task_count(spark, sf_dir))


def lif_03_claims_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def lif_04_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.roll_up_decisions(tables.expense_items(spark, sf_dir))


def lif_05_claim_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    return lifecycle.claim_totals(claims, tables.expense_items(spark, sf_dir))


def lif_06_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.check_transitions(tables.status_history(spark, sf_dir))


def lif_08_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.lifecycle_snapshot(tables.status_history(spark, sf_dir))


def lif_09_status_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.status_sets(tables.status_history(spark, sf_dir).select("event_id", F.col("to_status").alias("status")))


def lif_15_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.dashboard(flagship(spark, sf_dir))


def aud_02_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    return lifecycle.audit_trails(e.select("event_id", F.col("user_id").alias("entity_id"), (F.col("event_id") % 10).alias("actor"), F.col("ts").alias("occurred_at")))


def aud_05_operation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    spans = e.select(F.col("event_type").alias("operation"), F.floor("value").cast("long").alias("duration_ms"), (F.col("event_type") == "error").alias("failed"))
    return lifecycle.operation_metrics(spans, slow_ms=50)


def ven_03_vendor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEN-1 and VEN-3."""
    return U.vendor_stats(tables.fingerprints(spark, sf_dir))


def dup_01_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, least and greatest candidate per item."""
    pairs = U.candidate_pairs(U.with_keys(tables.fingerprints(spark, sf_dir)))
    return pairs.groupBy("item_id").agg(F.count("*").alias("candidates"), F.min("other_id").alias("least"), F.max("other_id").alias("most"))


def dup_12_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP-2, DUP-8 and DUP-12 over the candidates of DUP-1."""
    fp = U.with_keys(tables.fingerprints(spark, sf_dir)).select("item_id", "claim_id", "vendor", "expense_date", "amount_usd", "invoice_number", U.packed(F.col("checksum")).alias("checksum"))
    return U.verdict(U.pair_signals(fp, U.candidate_pairs(fp, carry=U.SIGNAL_COLUMNS)))


def dup_09_cross_employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cross_employee(U.with_keys(tables.fingerprints(spark, sf_dir)))


def dup_14_duplicate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.duplicate_items(U.with_keys(tables.expense_items(spark, sf_dir)))


def dup_15_same_day_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.same_day_vendor(U.with_keys(tables.expense_items(spark, sf_dir)))


def dup_16_same_file_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.same_file_hash(U.with_keys(tables.fingerprints(spark, sf_dir)), tables.task_count(spark, sf_dir))


def txt_03_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.split_paragraphs(F.col("text"))).cast("long").alias("paragraphs"), T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def txt_09_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(F.encode(T.strip_page_numbers(F.col("text")), "UTF-8")).alias("digest"))


def txt_12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.load(spark, sf_dir, "documents")
    parts = T.quality_parts(F.col("text"))
    staged = T.with_language(docs.select("doc_id", "text")).select("doc_id", "language", F.contains("text", F.lit("\n")).alias("several"), *[c.alias(n) for n, c in parts.items()])
    made = {n: F.col(n) for n in parts}
    scored = staged.withColumn("score", F.round(T.quality_score(made, F.col("several"), F.col("language").isNotNull()), 3))
    return scored.drop("several", "language")


def doc_01_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_documents(tables.load(spark, sf_dir, "documents"))


def doc_02_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_versions(tables.load(spark, sf_dir, "documents"))


def doc_07_count_by_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "embeddings")
    return D.count_by_spec(e.select((F.col("label") % 2).alias("tenant"), F.col("label").alias("spec")))


def doc_11_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK-8 and DOC-11: chunks and back."""
    whole = D.reassemble(D.paragraph_chunks(tables.load(spark, sf_dir, "documents")))
    return whole.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def chk_08_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.paragraph_chunks(tables.load(spark, sf_dir, "documents")).drop("chunk")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def emb_02_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(V.l2_norm(F.col("embedding")), 6).alias("norm"), F.round(V.l2_norm(V.normalize(F.col("embedding"))), 6).alias("unit"))


def emb_05_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.centroids(_vectors(spark, sf_dir))
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return V.knn(v.filter("vec_id % 20 = 0").select("vec_id", "embedding"), v, 10)


def emb_06_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def ret_04_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.min_max(_neighbours(spark, sf_dir)).select("query_id", "vec_id", F.round("scaled", 4).alias("scaled"))


def ret_06_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuses the neighbours with the same ones ranked by id."""
    from pyspark.sql import Window as W

    near = _neighbours(spark, sf_dir).select("query_id", "vec_id", "rank")
    by_id = near.select("query_id", "vec_id", F.row_number().over(W.partitionBy("query_id").orderBy("vec_id")).alias("rank"))
    return V.rrf({"dense": near, "ids": by_id}, {"dense": 0.6, "ids": 0.4}).select("query_id", "vec_id", F.round("fused", 9).alias("fused"), "rank")


_PLAIN = (
    src_01_expense_items, pol_02_rules_as_of, pol_07_check_age, pol_08_check_limits, pol_12_policy_report, frd_07_screen_fraud, frd_08_claim_fraud,
    lif_01_route_items, lif_02_hold_reasons, lif_03_claims_audit, lif_04_decisions, lif_05_claim_totals, lif_06_transitions, lif_08_snapshot, lif_09_status_sets, lif_15_dashboard,
    aud_02_trails, aud_05_operation_metrics, ven_03_vendor_stats, dup_01_candidates, dup_09_cross_employee, dup_12_verdicts, dup_14_duplicate_items, dup_15_same_day_vendor, dup_16_same_file_hash,
    txt_03_paragraphs, txt_09_page_numbers, txt_12_quality, doc_01_dedup, doc_02_versions, doc_07_count_by_spec, doc_11_reassemble, chk_08_chunks,
    emb_02_norms, emb_05_centroids, emb_06_knn, ret_04_min_max, ret_06_rrf,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*_PLAIN, *claims.QUERIES, *library.QUERIES)} | knowledge.QUERIES | catalogue.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | claims.SQL | knowledge.SQL | library.SQL | catalogue.SQL
