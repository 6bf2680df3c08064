"""Fraud screening by windows over each employee's earlier items (FRD-*).

"Earlier" is (submission date, claim, line).  Sums run over all earlier items;
nothing is capped and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Amounts just under a limit, above the first and up to the second.
BANDS = ((23.5, 25.0), (47.5, 50.0), (115.0, 120.0), (242.0, 250.0), (485.0, 500.0))
ORDER = ("submission_date", "claim_id", "line_number")


def vendor_key(vendor: Column) -> Column:
    return F.lower(F.trim(vendor))


def _before(*keys: str):
    return W.partitionBy(*keys).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)


def screen_fraud(items: DataFrame, parts: int | None = None) -> DataFrame:
    """Flags, risk score, level and action of every item (FRD-1 to FRD-7); ``parts`` is the number of tasks that employees are dealt to."""
    live = F.coalesce(F.col("status") != "Rejected", F.lit(True))
    same_day = _before("employee_id", "_vendor", "expense_date")
    f = items.withColumn("_vendor", vendor_key(F.coalesce("merchant_vendor", F.lit(""))))
    # All windows share the employee prefix: one exchange, then sorts.
    f = (f.repartition("employee_id") if parts is None else f.repartition(parts, "employee_id")).withColumns(
        {
            "_twins": F.count(F.when(live, 1)).over(_before("employee_id", "_vendor", "expense_date", "amount_usd")),
            "_same_day": F.count(F.when(live, 1)).over(same_day),
            "_same_day_usd": F.coalesce(F.sum(F.when(live, F.col("amount_usd"))).over(same_day), F.lit(0)),
            "_prior": F.count("*").over(_before("employee_id")),
            "_prior_usd": F.coalesce(F.sum("amount_usd").over(_before("employee_id")), F.lit(0)),
        }
    )
    amount = F.coalesce(F.col("amount_usd"), F.lit(0)).cast("double")
    total = F.col("_same_day_usd").cast("double") + amount
    split_taxi = (F.col("_same_day") > 0) & (F.col("category") == "Taxi / Cab / Ride-hailing") & (total > 50)
    split_meal = (F.col("_same_day") > 0) & (F.col("category") == "Meals") & (total > 25)
    near = F.lit(False)
    for low, high in BANDS:
        near = near | ((amount > low) & (amount <= high))
    fast = (F.col("_prior") > 3) & (amount * F.col("_prior") > F.col("_prior_usd").cast("double") * 3.5) & (amount > 150)
    ride = F.col("_vendor").rlike("uber|lyft|taxi") & (F.col("category") == "Meals")
    flags = (
        (F.col("_twins") > 0, "DUPLICATE_SUBMISSION", 50),
        (split_taxi, "SPLIT_TRANSACTION", 35),
        (split_meal, "SPLIT_TRANSACTION", 30),
        (near, "THRESHOLD_ENGINEERING", 15),
        (fast, "HIGH_SPEND_VELOCITY", 20),
        (ride, "VENDOR_CATEGORY_MISMATCH", 25),
    )
    score = F.lit(0)
    for hit, _, points in flags:
        score = score + F.when(hit, points).otherwise(0)
    out = f.withColumns({"risk_score": score, "flags": F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, name, _ in flags]))})
    level = F.when(F.col("risk_score") >= 70, "CRITICAL").when(F.col("risk_score") >= 40, "HIGH").when(F.col("risk_score") >= 15, "MEDIUM").otherwise("LOW")
    action = (
        F.when(F.col("risk_score") >= 70, "INVESTIGATE_FRAUD").when(F.col("risk_score") >= 40, "FINANCE_AUDIT")
        .when(F.col("risk_score") >= 15, "MANAGER_REVIEW").otherwise("AUTO_APPROVE")
    )
    return out.select(
        *items.columns, "risk_score", F.least("risk_score", F.lit(100)).alias("risk_score_capped"), level.alias("risk_level"), action.alias("recommended_action"),
        ((F.size("flags") > 0) & (F.col("risk_score") >= 15)).alias("is_flagged"), "flags",
    )


def claim_fraud(screened: DataFrame) -> DataFrame:
    """Worst item, any flag and all flags with their line, per claim (FRD-8)."""
    worst = F.struct("risk_score", -F.col("line_number"))
    lines = F.when(F.size("flags") > 0, F.struct("line_number", F.array_join("flags", "+").alias("flags")))
    return screened.groupBy("claim_id").agg(
        F.max("risk_score").alias("risk_score"),
        F.max_by("line_number", worst).alias("worst_line"),
        F.max_by("risk_level", worst).alias("risk_level"),
        F.bool_or("is_flagged").alias("is_flagged"),
        F.array_join(F.transform(F.sort_array(F.collect_list(lines)), lambda x: F.concat_ws(":", x["line_number"].cast("string"), x["flags"])), ";").alias("flags"),
    )


def latest_fraud(results: DataFrame) -> DataFrame:
    """The newest verdict of each claim (FRD-9)."""
    newest = W.partitionBy("claim_id").orderBy(F.desc("evaluated_at"), F.desc("created_at"), F.desc("id"))
    return results.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def apply_manual_flags(latest: DataFrame, flags: DataFrame) -> DataFrame:
    """A manual flag lifts the score to 40 at least and keeps earlier flags (FRD-10)."""
    return flags.join(latest.select("claim_id", "risk_score", "flags"), "claim_id", "left").select(
        "claim_id",
        F.greatest(F.coalesce("risk_score", F.lit(0)), F.lit(40)).alias("risk_score"),
        F.lit("HIGH").alias("risk_level"),
        F.array_append(F.coalesce("flags", F.array().cast("array<string>")), F.lit("MANUAL_FLAG")).alias("flags"),
    )
