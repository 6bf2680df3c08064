"""Expense policy as column expressions over items joined with a small, broadcast rule table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The seed rules (code, category, priority, max, auto, receipt above, pre-approval, actions, conditions).
SEED_RULES = [
    ("CLAIM_AGE_LIMIT", "*", 1, None, None, None, False, '{"maxClaimAgeDays":90}', "{}"),
    ("MEALS_STANDARD", "Meals", 100, 40.0, 25.0, 25.0, False, '{"autoApproveBelowUsd":25,"requireReceiptAboveUsd":25,"prohibitedItems":["alcohol"]}', "{}"),
    ("GROUND_TRANSPORT_STANDARD", "Taxi / Cab / Ride-hailing", 100, 150.0, 50.0, 0.0, False, '{"autoApproveBelowUsd":50,"requireReceiptAboveUsd":0}', "{}"),
    ("FLIGHTS_STANDARD", "Air Travel", 90, 10000.0, None, 0.0, True, '{"autoApprove":false,"cabinClassByGrade":{"L1":"Economy","L2":"Economy","L3":"Economy","L4":"Economy","L5":"Premium Economy >6h","Director":"Premium Economy >6h","VP":"Business >6h"}}', "{}"),
    ("LODGING_STANDARD", "Hotel / Lodging", 95, 250.0, None, 0.0, False, '{"autoApprove":false,"nightlyCapUsdByGrade":{"L1":120,"L2":120,"L3":120,"L4":250,"L5":250,"Director":250,"VP":250}}', "{}"),
    ("CLIENT_ENTERTAINMENT_STANDARD", "Client / Business Entertainment", 90, 500.0, None, 50.0, True, '{"autoApprove":false,"requireAttendees":true,"minimumAttendeeTextLength":5}', '{"gradeTiers":["L5","Director","VP"]}'),
]
#: Report ids by the start of a rule's code (over the maximum, within it, to be reviewed).
REPORT_IDS = {
    "MEALS": ("MEAL_MAX_EXCEEDED", "MEAL_MAX_PASS", "MEAL_REQUIRES_REVIEW"),
    "TAXI": ("TAXI_MAX_EXCEEDED", "TAXI_MAX_PASS", "TAXI_REVIEW_REQUIRED"),
    "GROUND_TRANSPORT": ("TAXI_MAX_EXCEEDED", "TAXI_MAX_PASS", "TAXI_REVIEW_REQUIRED"),
    "AIR": ("FLIGHT_MAX_EXCEEDED", "FLIGHT_MAX_PASS", "FLIGHT_ALWAYS_MANUAL"),
    "FLIGHT": ("FLIGHT_MAX_EXCEEDED", "FLIGHT_MAX_PASS", "FLIGHT_ALWAYS_MANUAL"),
    "HOTEL": ("LODGING_LIMIT_EXCEEDED", "LODGING_LIMIT_PASS", "LODGING_ALWAYS_MANUAL"),
    "LODGING": ("LODGING_LIMIT_EXCEEDED", "LODGING_LIMIT_PASS", "LODGING_ALWAYS_MANUAL"),
    "CLIENT": ("CLIENT_ENT_MAX_EXCEEDED", "CLIENT_ENT_MAX_PASS", "CLIENT_ENT_ALWAYS_MANUAL"),
}
OTHER_IDS = ("CATEGORY_MAX_EXCEEDED", "CATEGORY_MAX_PASS", "CATEGORY_REQUIRES_REVIEW")
RULE_SCHEMA = "code string, category string, priority int, max_amount double, auto_limit double, receipt_above double, pre_approval boolean, actions string, conditions string"


def seed_rules(spark: SparkSession) -> DataFrame:
    """The seed rules as version 1, in force from 2020 on."""
    rules = spark.createDataFrame(SEED_RULES, RULE_SCHEMA)
    return rules.selectExpr("*", "1 AS version", "true AS is_active", "DATE '2020-01-01' AS effective_from", "CAST(NULL AS DATE) AS effective_to")


def in_force(on: Column, include_retired: bool = False, field: Callable[[str], Column] = F.col) -> Column:
    """Whether a rule holds on a date: an inclusive window with an open end; ``field`` reads the rule."""
    window = (field("effective_from") <= on) & (field("effective_to").isNull() | (field("effective_to") >= on))
    return window if include_retired else window & field("is_active")


def effective_rules(rules: DataFrame, on: str, include_retired: bool = False) -> DataFrame:
    """Rules in force on a date, by priority and category (POL-1)."""
    return rules.filter(in_force(F.lit(on).cast("date"), include_retired)).orderBy("priority", "category", "code")


def publish_rules(current: DataFrame, batch: DataFrame, start: str) -> DataFrame:
    """The next version of each code in ``batch``; the one before is retired (POL-3)."""
    latest = current.groupBy("code").agg(F.max("version").alias("_v"))
    new = batch.join(latest, "code", "left").withColumns(
        {
            "version": F.coalesce(F.col("_v"), F.lit(0)) + 1,
            "is_active": F.lit(True),
            "effective_from": F.lit(start).cast("date"),
            "effective_to": F.lit(None).cast("date"),
        }
    )
    touched = current.join(batch.select("code", F.lit(True).alias("_new")), "code", "left")
    retire = F.col("_new").isNotNull() & F.col("is_active")
    end = F.greatest(F.lit(start).cast("date"), "effective_from")
    old = touched.withColumns(
        {"effective_to": F.when(retire, end).otherwise(F.col("effective_to")), "is_active": F.col("is_active") & F.col("_new").isNull()}
    )
    return old.select(current.columns).unionByName(new.select(current.columns))


def prepare_batch(submitted: DataFrame) -> DataFrame:
    """Submitted rules with a code, from the category where it is missing, and their limit as a number or as it is worded (POL-4).

    ``limit`` is text; max_amount is its number, limit_expression what is no number.
    """
    slug = F.regexp_replace(F.regexp_replace(F.upper("category"), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    number = F.regexp_replace(F.trim("limit"), ",", "").try_cast("double")
    code = F.coalesce(F.when(F.trim("code") != "", F.trim("code")), F.concat(slug, F.lit("_STANDARD")))
    worded = F.when(number.isNull() & (F.trim("limit") != ""), F.trim("limit"))
    return submitted.withColumns({"code": code, "max_amount": number, "limit_expression": worded}).drop("limit")


def replace_ruleset(current: DataFrame, batch: DataFrame, start: str) -> DataFrame:
    """Publish ``batch`` and retire all codes that it lacks (POL-4)."""
    out = publish_rules(current, batch, start)
    gone = out.select("code").distinct().join(batch.select("code"), "code", "left_anti").withColumn("_gone", F.lit(True))
    marked = out.join(gone, "code", "left")
    retire = F.col("_gone").isNotNull() & F.col("is_active")
    end = F.greatest(F.lit(start).cast("date"), "effective_from")
    return marked.withColumns(
        {"effective_to": F.when(retire, end).otherwise(F.col("effective_to")), "is_active": F.col("is_active") & F.col("_gone").isNull()}
    ).select(current.columns)


def latest_versions(rules: DataFrame) -> DataFrame:
    """The newest version of each code (POL-5)."""
    newest = W.partitionBy("code").orderBy(F.desc("version"))
    return rules.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def rollback(rules: DataFrame, code: str, version: int) -> DataFrame:
    """Rules with one version of a code active again, and no other of that code (POL-5)."""
    return rules.withColumn("is_active", F.when(F.col("code") == code, F.col("version") == version).otherwise(F.col("is_active")))


def age_limit_of_rule() -> Column:
    """Days after which an expense is too old, as a rule's action or condition has it; null for most rules."""
    condition = lambda name: F.get_json_object("conditions", f"$.submissionAgeDays.{name}").cast("double")
    return F.coalesce(F.get_json_object("actions", "$.maxClaimAgeDays").cast("double"), condition("lte"), condition("max"))


def rules_as_of(items: DataFrame, rules: DataFrame, include_retired: bool = False) -> DataFrame:
    """Each item with its rule and age limit: the claim's earliest expense date picks the ruleset (POL-2).

    An item without a rule in force keeps its row, with nulls; so does one without
    an age limit in force.  Among rules of one category, and among age limits, the
    least (priority, category, code), then the newest version, decides.

    The rule table is folded first, to one list per category and one of all age
    limits, so that an equi-join and a scalar subquery are all that items go through;
    one shuffle by claim.
    """
    dated = items.withColumn("ruleset_date", F.min("expense_date").over(W.partitionBy("claim_id")))
    order = [F.col("priority"), F.col("category"), F.col("code"), -F.col("version")]
    named = lambda columns: F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)], *columns)
    listed = lambda columns: F.sort_array(F.collect_list(named(columns)))
    first = lambda rows: F.try_element_at(
        F.filter(rows, lambda r: in_force(F.col("ruleset_date"), include_retired, r.getItem)), F.lit(1)
    )
    window = ["effective_from", "effective_to", "is_active"]
    limits = rules.withColumn("age_limit", age_limit_of_rule()).filter("age_limit IS NOT NULL")
    limits = limits.agg(listed(["age_limit", *window]).alias("_limits"))  # one row, also without any rule
    own = [c for c in rules.columns if c not in ("category", *window)]
    of_category = rules.filter("category <> '*'").groupBy("category").agg(listed([*own, *window]).alias("_rules"))
    found = dated.join(of_category, "category", "left").withColumn("_limits", limits.scalar())
    found = found.withColumns({"_rule": first(F.col("_rules")), "age_limit": first(F.col("_limits"))["age_limit"]})
    return found.select(*dated.columns, *[F.col(f"_rule.{c}").alias(c) for c in [*own, *window]], "age_limit")


def _number(path: str) -> Column:
    return F.get_json_object("actions", f"$.{path}").cast("double")


def _by_grade(name: str, kind: str) -> Column:
    """(key, value) of each grade; entries rather than a map, which has no order to sort rules by."""
    return F.map_entries(F.from_json(F.get_json_object("actions", f"$.{name}"), f"map<string,{kind}>"))


def typed_rules(rules: DataFrame) -> DataFrame:
    """Rules with what their JSON says as typed columns, so that it is read once for each rule and not for each item."""
    said = lambda name, value: F.coalesce(F.get_json_object("actions", f"$.{name}") == value, F.lit(False))
    return rules.withColumns(
        {
            "caps": _by_grade("nightlyCapUsdByGrade", "double"),
            "cabins": _by_grade("cabinClassByGrade", "string"),
            "most": F.coalesce(_number("maxAmountUsd"), F.col("max_amount")),
            "auto": F.coalesce(_number("autoApproveBelowUsd"), _number("autoApproveLimitUsd"), F.col("auto_limit")),
            "receipt_from": F.coalesce(_number("requireReceiptAboveUsd"), F.col("receipt_above")),
            "never_auto": said("autoApprove", "false"),
            "grades": F.from_json(F.get_json_object("conditions", "$.gradeTiers"), "array<string>"),
            "needs_approval": F.coalesce(F.get_json_object("actions", "$.requirePreApproval") == "true", F.col("pre_approval"), F.lit(False)),
            "prohibited": F.transform(F.from_json(F.get_json_object("actions", "$.prohibitedItems"), "array<string>"), _alnum),
            "needs_attendees": said("requireAttendees", "true"),
            "attendee_chars": F.coalesce(_number("minimumAttendeeTextLength"), F.lit(1)),
        }
    )


def with_limits(ruled: DataFrame) -> DataFrame:
    """Amount, limits and ages that the checks compare (POL-7, POL-8), of items with their ``typed_rules``."""
    of_grade = lambda c: F.try_element_at(F.filter(c, lambda e: e["key"] == F.col("employee_grade")), F.lit(1))["value"]
    return ruled.withColumns(
        {
            "amount": F.coalesce(F.col("amount_usd"), F.lit(0)).cast("double"),
            "days": F.greatest(F.coalesce(F.datediff("submission_date", "expense_date"), F.lit(0)), F.lit(0)),
            "max_limit": F.coalesce(of_grade("caps"), F.col("most")),
            "cabin": of_grade("cabins"),
            "on_receipt": F.when(F.size("prohibited") > 0, receipt_items()),
            "never_auto": F.coalesce("never_auto", F.lit(False)),
            "needs_approval": F.coalesce("needs_approval", F.lit(False)),
            "needs_attendees": F.coalesce("needs_attendees", F.lit(False)),
            "attendee_chars": F.coalesce("attendee_chars", F.lit(1)),
        }
    )


def _report_id(which: int) -> Column:
    out = F.lit(OTHER_IDS[which])
    for start, ids in REPORT_IDS.items():
        out = F.when(F.col("code").startswith(start), ids[which]).otherwise(out)
    return out


def _alnum(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def receipt_items() -> Column:
    """What a receipt says it holds, alphanumerics only: the entries of its list, and its keys with something behind them.

    A key stands for its item with or without ``has`` or ``contains`` before it; nothing
    is behind it if its value is empty, false or 0.
    """
    listed = F.from_json(F.get_json_object("extracted_receipt", "$.prohibitedItems"), "array<string>")
    entries = F.map_entries(F.from_json("extracted_receipt", "map<string,string>"))
    none = F.array().cast("array<string>")
    said = F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].isin("", "false", "0", "0.0", "[]", "{}"))
    keys = F.transform(said, lambda e: _alnum(e["key"]))
    bare = F.transform(keys, lambda k: F.regexp_replace(k, "^(has|contains)", ""))
    return F.concat(F.transform(F.coalesce(listed, none), _alnum), F.coalesce(keys, none), F.coalesce(bare, none))


def evaluate_expense_policy(items: DataFrame, rules: DataFrame) -> DataFrame:
    """One policy report per item (POL-7 to POL-12).

    checks is an array of (rule_id, passed) in the order in which they are made.
    """
    f = with_limits(rules_as_of(items, typed_rules(rules)))
    missing = F.col("code").isNull()
    over_age = F.col("days") > F.col("age_limit")
    over_max = F.col("amount") > F.col("max_limit")
    client = F.col("code").startswith("CLIENT")
    bad_grade = (F.size("grades") > 0) & ~F.array_contains("grades", "*") & ~F.array_contains("grades", F.col("employee_grade"))
    no_receipt = (F.col("amount") > F.col("receipt_from")) & ~F.col("receipt_attached")
    no_approval = F.col("needs_approval") & ~F.coalesce("has_pre_approval", F.lit(False))
    found = F.coalesce(F.arrays_overlap("prohibited", "on_receipt"), F.lit(False))
    no_attendees = F.col("needs_attendees") & (F.length(F.trim(F.coalesce("attendees", F.lit("")))) < F.col("attendee_chars"))
    review = F.col("never_auto") | (F.col("amount") > F.coalesce("auto", F.lit(float("inf"))))

    def check(when: Column, rule_id: Column | str, passed: bool) -> Column:
        name = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
        return F.when(F.coalesce(when, F.lit(False)), F.struct(name.alias("rule_id"), F.lit(passed).alias("passed")))

    ruled = ~missing
    f = f.withColumn(
        "checks",
        F.array_compact(
            F.array(
                check(over_age, "AGE_LIMIT_90_DAYS", False),
                check(~over_age, "AGE_LIMIT_90_DAYS", True),
                check(missing, "POLICY_RULE_MISSING", False),
                check(ruled & F.col("max_limit").isNull(), F.concat("code", F.lit("_MAX_NOT_CONFIGURED")), False),
                check(ruled & over_max, _report_id(0), False),
                check(ruled & ~over_max, _report_id(1), True),
                check(ruled & review, _report_id(2), True),
                check(bad_grade, F.when(client, F.lit("CLIENT_ENT_GRADE_RESTRICTION")).otherwise(F.concat("code", F.lit("_GRADE_RESTRICTION"))), False),
                check((F.size("grades") > 0) & ~bad_grade, F.when(client, F.lit("CLIENT_ENT_GRADE_PASS")).otherwise(F.concat("code", F.lit("_GRADE_PASS"))), True),
                check(F.col("cabin").isNotNull(), F.when(F.col("cabin") == "Economy", "FLIGHT_CLASS_L1_L4").when(F.col("cabin").startswith("Premium"), "FLIGHT_CLASS_L5").otherwise("FLIGHT_CLASS_VP"), True),
                check(no_approval, F.concat("code", F.lit("_PRE_APPROVAL_REQUIRED")), False),
                check(no_receipt, "RECEIPT_REQUIRED_MISSING", False),
                check(found, "MEAL_ALCOHOL_PROHIBITED", False),
                check(no_attendees, F.when(client, F.lit("CLIENT_ENT_MISSING_ATTENDEES")).otherwise(F.concat("code", F.lit("_MISSING_ATTENDEES"))), False),
            )
        ),
    )
    failed = F.exists("checks", lambda c: ~c["passed"])
    manual = failed | F.coalesce(F.col("auto").isNull() | review, F.lit(True))
    return f.select(
        *items.columns,
        (~failed).alias("policy_passed"),
        manual.alias("manual_review"),
        F.coalesce(F.col("amount") <= F.col("max_limit"), F.lit(False)).alias("within_max"),
        F.coalesce(F.col("amount") <= F.col("auto"), F.lit(False)).alias("within_auto"),
        F.col("max_limit").alias("max_limit"),
        F.col("days").alias("days_since_expense"),
        "checks",
    )
