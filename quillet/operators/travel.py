"""Local-travel rules: which apply to an item, and what they allow (POL-13, POL-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Grade to travel band.
BANDS = {"VP": "Band 1", "Director": "Band 1", "L5": "Band 2", "L4": "Band 3", "L3": "Band 3", "L2": "Band 4", "L1": "Band 4"}
#: Daily caps in INR per band.
TAXI_CAPS = {"Band 1": 1200.0, "Band 2": 900.0, "Band 3": 600.0, "Band 4": 300.0}
MEAL_CAPS = {"Band 1": 300.0, "Band 2": 250.0, "Band 3": 200.0, "Band 4": 150.0}
MAX_RULES = 10_000
_RULES = "code string, rule_type string, category string, travel_type string, grade_band string, duration string, cap double, currency string, priority int"
_ANY = "*"


def seed_travel_rules(spark: SparkSession) -> DataFrame:
    """The rules of local day travel, and a catch-all without a scope."""
    rows = [(f"LOCAL_TAXI_{b[-1]}", "AMOUNT_CAP", "Taxi / Cab / Ride-hailing", "Local", b, "Day", x, "INR", 10) for b, x in TAXI_CAPS.items()]
    rows += [(f"LOCAL_MEAL_{b[-1]}", "AMOUNT_CAP", "Meals", "Local", b, "Day", x, "INR", 20) for b, x in MEAL_CAPS.items()]
    rows += [("LOCAL_HOTEL_PROHIBITED", "PROHIBITED", "Hotel / Lodging", "Local", None, None, None, "INR", 5)]
    rows += [("UNSCOPED_CAP", "AMOUNT_CAP", None, None, None, None, 400.0, "INR", 90)]
    return spark.createDataFrame(rows, _RULES)


def match_travel_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items (item_id, category, travel_type, grade_band, duration, amount, currency) with the rules that apply (POL-13).

    A null axis of a rule matches anything; a rule without any axis applies only
    where no other does.  Each item is looked up under its category and under the
    wildcard, so the join stays an equi-join; the rules are broadcast only when
    there are at most ``MAX_RULES``.
    """
    scope = ["category", "travel_type", "grade_band", "duration"]
    r = rules.select(
        F.coalesce("category", F.lit(_ANY)).alias("_key"), *[F.col(a).alias(f"_r_{a}") for a in scope[1:]],
        "code", "rule_type", "cap", F.col("currency").alias("rule_currency"), "priority",
        F.coalesce(*[F.col(a) for a in scope]).isNotNull().alias("specific"),
    )
    if rules.limit(MAX_RULES + 1).count() <= MAX_RULES:
        r = F.broadcast(r)
    keyed = items.withColumn("_key", F.explode(F.array_distinct(F.array(F.coalesce("category", F.lit(_ANY)), F.lit(_ANY)))))
    fits = [F.col(f"_r_{a}").isNull() | (F.col(f"_r_{a}") == F.col(a)) for a in scope[1:]]
    met = keyed.join(r, "_key").filter(fits[0] & fits[1] & fits[2])
    any_specific = F.max("specific").over(W.partitionBy("item_id"))
    return met.withColumn("_s", any_specific).filter("specific OR NOT _s").drop("_key", "_s", *[f"_r_{a}" for a in scope[1:]])


def evaluate_travel_policy(items: DataFrame, rules: DataFrame) -> DataFrame:
    """item_id, passed, manual_review, eligible, checks (POL-14).

    A prohibition leaves nothing; caps in the item's currency lower the amount;
    another currency only asks for review.  Checks are in the order of priority and
    code, '+' passed and '-' not.  Without a rule the item passes whole.
    """
    met = match_travel_rules(items, rules)
    banned = F.col("rule_type") == "PROHIBITED"
    capped = (F.col("rule_type") == "AMOUNT_CAP") & F.col("cap").isNotNull()
    foreign = capped & (F.col("rule_currency") != F.col("currency"))
    over = capped & ~foreign & (F.col("amount") > F.col("cap"))
    name = F.when(banned | over, F.concat("code", F.lit("-"))).when(foreign, F.concat("code", F.lit("_CURRENCY_MISMATCH+"))).when(capped, F.concat("code", F.lit("+")))
    judged = met.groupBy("item_id").agg(
        F.bool_or(banned | over).alias("_bad"),
        F.bool_or(banned).alias("_banned"),
        F.bool_or(foreign).alias("_foreign"),
        F.min(F.when(capped & ~foreign, F.col("cap"))).alias("_cap"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(name.isNotNull(), F.struct("priority", "code", name.alias("t"))))), lambda x: x["t"]), ",").alias("_checks"),
    )
    no = F.lit(False)
    return items.select("item_id", "amount").join(judged, "item_id", "left").select(
        "item_id",
        (~F.coalesce("_bad", no)).alias("passed"),
        (F.coalesce("_bad", no) | F.coalesce("_foreign", no)).alias("manual_review"),
        F.round(F.when(F.coalesce("_banned", no), 0.0).otherwise(F.least("amount", "_cap")), 2).alias("eligible"),
        F.coalesce("_checks", F.lit("")).alias("checks"),
    )
