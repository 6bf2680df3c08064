"""Routing, roll-ups and audits of claim histories (LIF-*, AUD-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The legal moves and who may ask for each state.
EDGES = {
    "Draft": ["Submitted"],
    "Submitted": ["Processing", "Withdrawn"],
    "Processing": ["Auto_Approved", "Manager_Review", "Finance_Review", "Flagged_Fraud", "Withdrawn", "Failed"],
    "Auto_Approved": ["Approved", "Manager_Review", "Flagged_Fraud", "Withdrawn"],
    "Manager_Review": ["Finance_Review", "Approved", "Rejected", "Flagged_Fraud", "Withdrawn"],
    "Finance_Review": ["Approved", "Rejected", "Flagged_Fraud", "Withdrawn"],
    "Approved": ["Flagged_Fraud"],
    "Flagged_Fraud": ["Manager_Review", "Finance_Review", "Approved", "Rejected"],
}
ROLES = {
    "Submitted": ["employee", "admin"],
    "Processing": ["system"],
    "Auto_Approved": ["system"],
    "Manager_Review": ["system", "manager", "finance", "admin"],
    "Finance_Review": ["system", "manager", "finance", "admin"],
    "Approved": ["manager", "finance", "admin"],
    "Rejected": ["manager", "finance", "admin"],
    "Reimbursed": ["finance", "admin"],
    "Flagged_Fraud": ["system", "manager", "finance", "admin", "auditor"],
    "Withdrawn": ["employee", "admin"],
    "Failed": ["system"],
}
TERMINAL = ["Rejected", "Reimbursed", "Withdrawn", "Failed"]
FRAUD_ROUTE = 40


def route_items(judged: DataFrame) -> DataFrame:
    """Where each item goes: fraud, then policy, travel rules and classification, then approval (LIF-1).

    travel_passed, travel_review and category_review count where they are columns; null is no objection.
    """
    fraud = F.col("is_flagged") & (F.col("risk_score") >= FRAUD_ROUTE)
    hold = ~F.col("policy_passed") | F.col("manual_review")
    for name, bad in (("travel_passed", False), ("travel_review", True), ("category_review", True)):
        if name in judged.columns:
            hold = hold | F.coalesce(F.col(name) == bad, F.lit(False))
    return judged.withColumn("route", F.when(fraud, "Fraud_Flag").when(hold, "Policy_Hold").otherwise("Auto_Approved"))


def hold_reasons(routed: DataFrame, parts: int | None = None) -> DataFrame:
    """Why items of a claim are held, in line order (LIF-2); ``parts`` is the number of tasks that claims are dealt to."""
    broken = F.array_join(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["rule_id"]), ",")
    reason = F.when(F.col("route") == "Fraud_Flag", F.array_join("flags", ",")).when(
        F.col("route") == "Policy_Hold", F.when(broken != "", broken).otherwise(F.lit("Held for manual review."))
    )
    line = F.when(reason.isNotNull(), F.struct("line_number", F.concat(F.lit("Item #"), F.col("line_number"), F.lit(" ("), F.col("category"), F.lit("): "), reason).alias("t")))
    lines = routed.select("claim_id", line.alias("line"))
    if parts is not None:
        lines = lines.repartition(parts, "claim_id")
    return lines.groupBy("claim_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["t"]), "; ").alias("hold_reasons"))


def roll_up_claims(routed: DataFrame) -> DataFrame:
    """Status, totals and counts per claim in one aggregate (LIF-3, LIF-5)."""
    is_ = lambda s: F.col("route") == s
    return routed.groupBy("claim_id").agg(
        F.when(F.bool_or(is_("Fraud_Flag")), "Flagged_Fraud").when(F.bool_or(is_("Policy_Hold")), "Manager_Review")
        .when(F.bool_and(is_("Auto_Approved")), "Auto_Approved").otherwise("Manager_Review").alias("claim_status"),
        F.sum("amount_usd").alias("total_usd"),
        F.count("*").alias("item_count"),
        F.max("risk_score").alias("risk_score"),
        F.count_if(~F.col("policy_passed")).alias("violations"),
    )


def roll_up_decisions(items: DataFrame) -> DataFrame:
    """Status once every item is decided; null while one is pending (LIF-4)."""
    pending = F.col("status").isin("Submitted", "Policy_Hold", "Fraud_Flag")
    return items.groupBy("claim_id").agg(
        F.when(F.bool_or(pending), None).when(F.bool_and(F.col("status") == "Rejected"), "Rejected").otherwise("Approved").alias("decision")
    )


def claim_totals(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Totals of every claim, 0 without items (LIF-5)."""
    sums = items.groupBy("claim_id").agg(F.sum("amount_usd").alias("total_usd"), F.count("*").alias("item_count"))
    return claims.select("claim_id").join(sums, "claim_id", "left").select(
        "claim_id", F.coalesce("total_usd", F.lit(0)).cast("decimal(24,2)").alias("total_usd"), F.coalesce("item_count", F.lit(0)).alias("item_count")
    )


def check_transitions(history: DataFrame) -> DataFrame:
    """Moves that are not allowed, or not to the role that made them (LIF-6)."""
    edges = F.create_map(*[x for a, b in EDGES.items() for x in (F.lit(a), F.array(*map(F.lit, b)))])
    roles = F.create_map(*[x for a, b in ROLES.items() for x in (F.lit(a), F.array(*map(F.lit, b)))])
    moved = history.filter("from_status IS NOT NULL AND from_status <> to_status")
    return (
        moved.withColumn("illegal_edge", ~F.coalesce(F.array_contains(edges[F.col("from_status")], F.col("to_status")), F.lit(False)))
        .withColumn("illegal_role", ~F.coalesce(F.array_contains(roles[F.col("to_status")], F.col("actor_role")), F.lit(False)))
        .filter("illegal_edge OR illegal_role")
        .select("event_id", "claim_id", "from_status", "to_status", "actor_role", "illegal_edge", "illegal_role")
    )


def check_sequence(history: DataFrame) -> DataFrame:
    """Rows whose number or predecessor does not follow from the row before (LIF-7)."""
    w = W.partitionBy("claim_id").orderBy("sequence")
    checked = history.withColumns({"expected": F.row_number().over(w), "previous": F.lag("to_status").over(w)})
    return checked.filter("sequence <> expected OR NOT (from_status <=> previous)").select("event_id", "claim_id", "sequence", "expected")


def lifecycle_snapshot(history: DataFrame) -> DataFrame:
    """Current status and first entry per stage (LIF-8)."""
    first = lambda *s: F.min(F.when(F.col("to_status").isin(*s), F.col("occurred_at")))
    return history.groupBy("claim_id").agg(
        F.max_by("to_status", "sequence").alias("status"),
        first("Submitted").alias("submitted_at"),
        first("Processing").alias("processing_started_at"),
        first("Manager_Review", "Finance_Review").alias("review_started_at"),
        first("Approved", "Auto_Approved").alias("approved_at"),
        F.max(F.when(F.col("to_status").isin("Approved", "Rejected"), F.col("occurred_at"))).alias("decided_at"),
        first("Rejected").alias("rejected_at"),
        first("Reimbursed").alias("reimbursed_at"),
        first("Withdrawn").alias("withdrawn_at"),
        F.count("*").alias("moves"),
    )


def status_sets(df: DataFrame, status: str = "status") -> DataFrame:
    """Terminal, editable, withdrawable and reviewable (LIF-9)."""
    can = [s for s, to in EDGES.items() if "Withdrawn" in to]
    return df.withColumns(
        {
            "is_terminal": F.col(status).isin(*TERMINAL),
            "is_editable": F.col(status) == "Draft",
            "is_withdrawable": F.col(status).isin(*can),
            "is_reviewable": F.col(status).isin("Manager_Review", "Finance_Review", "Flagged_Fraud"),
        }
    )


def dashboard(claims: DataFrame) -> DataFrame:
    """Counts, auto-approve rate and paid total (LIF-15)."""
    is_ = lambda *s: F.col("claim_status").isin(*s)
    auto = F.count_if(is_("Auto_Approved"))
    return claims.agg(
        F.count_if(is_("Manager_Review", "Finance_Review")).alias("pending"),
        F.count_if(is_("Flagged_Fraud")).alias("flagged"),
        auto.alias("auto_approved"),
        F.round(100 * auto / F.greatest(F.count("*"), F.lit(1))).cast("long").alias("auto_rate"),
        F.sum(F.when(is_("Auto_Approved", "Approved"), F.col("total_usd"))).alias("paid_usd"),
    )


def audit_trails(logs: DataFrame) -> DataFrame:
    """Actors in the order they first appear, entries and last activity per entity (AUD-2)."""
    first = F.min(F.struct("occurred_at", "event_id")).alias("first")
    by_actor = logs.groupBy("entity_id", "actor").agg(first, F.count("*").alias("n"), F.max("occurred_at").alias("last"))
    # A list of actors, not of entries: each actor once per entity.
    actors = F.transform(F.sort_array(F.collect_list(F.struct("first", "actor"))), lambda x: x["actor"].cast("string"))
    return by_actor.groupBy("entity_id").agg(F.array_join(actors, ",").alias("actors"), F.sum("n").alias("entries"), F.max("last").alias("last_activity"))


def operation_metrics(spans: DataFrame, slow_ms: int = 2_000) -> DataFrame:
    """Count, failures, total, mean, longest and slow runs per operation (AUD-5)."""
    return spans.groupBy("operation").agg(
        F.count("*").alias("runs"), F.count_if("failed").alias("failures"), F.sum("duration_ms").alias("total_ms"),
        F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(F.col("duration_ms") >= slow_ms).alias("slow"),
    )
