"""Preparing submitted items (SUB-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_DAYS, LEAST_ATTENDEES, SURE = 90, 5, 0.7


def resolve_fields(df: DataFrame, fields: list[str], correction: str = "corrections", extracted: str = "extracted") -> DataFrame:
    """Each field from the correction, else as submitted, else as extracted (SUB-1)."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    pick = lambda f: F.coalesce(blank(F.get_json_object(correction, f"$.{f}")), blank(F.col(f).cast("string")), F.get_json_object(extracted, f"$.{f}"))
    return df.withColumns({f: pick(f) for f in fields})


def reject_reasons(today: Column, currency: str = "currency") -> Column:
    """Why an item is not valid, in fixed order; empty for a valid one (SUB-3)."""
    code = F.coalesce(F.col(currency), F.lit("USD"))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("amount_usd") <= 0, F.lit(True)), "AMOUNT_NOT_POSITIVE"),
            F.when(~code.rlike("^[A-Za-z]{3}$"), "CURRENCY_NOT_THREE_LETTERS"),
            F.when(F.col("expense_date") > F.date_add(today, 1), "DATE_IN_FUTURE"),
            F.when(F.col("attendees_required") & (F.length(F.trim(F.coalesce("attendees", F.lit("")))) < LEAST_ATTENDEES), "ATTENDEES_TOO_SHORT"),
        )
    )


def validate_items(items: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Valid items, and rejected ones with their reasons (SUB-3)."""
    judged = items.withColumn("reasons", reject_reasons(today))
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def stale_items(items: DataFrame, on: Column, days: int = STALE_DAYS) -> DataFrame:
    """Age in days and whether it passes the limit (SUB-4)."""
    age = F.greatest(F.datediff(on, "expense_date"), F.lit(0))
    return items.withColumn("age_days", age).withColumn("is_stale", age > days)


def coerce_custom_fields(values: DataFrame, schema: DataFrame) -> DataFrame:
    """(item_id, field, value, dropped): values of the category's fields in the form of their kind (SUB-5).

    ``values`` is (item_id, category, field, raw), ``schema`` (category, field, kind, choices);
    a null category in the schema holds for all.  Unknown fields and values that do
    not fit are dropped, with a note.
    """
    own = schema.filter("category IS NOT NULL")
    common = schema.filter("category IS NULL").select("field", F.col("kind").alias("_kind"), F.col("choices").alias("_choices"))
    met = values.join(own, ["category", "field"], "left").join(common, "field", "left")
    kind, choices = F.coalesce("kind", "_kind"), F.coalesce("choices", "_choices")
    raw = F.trim("raw")
    truth = F.when(F.lower(raw).isin("true", "yes", "1"), "true").when(F.lower(raw).isin("false", "no", "0"), "false")
    made = (
        F.when(kind == "text", F.when(raw != "", raw))
        .when(kind == "number", raw.try_cast("double").cast("string"))
        .when(kind == "date", raw.try_cast("date").cast("string"))
        .when(kind == "boolean", truth)
        .when(kind == "enum", F.when(F.array_contains(choices, raw), raw))
    )
    note = F.when(kind.isNull(), "UNKNOWN_FIELD").when(made.isNull(), F.concat(F.lit("NOT_A_"), F.upper(kind)))
    return met.select("item_id", "field", made.alias("value"), note.alias("dropped"))


def classification_outcome(df: DataFrame, categories: list[str], sure: float = SURE) -> DataFrame:
    """Closed-list category, mismatch with the employee's and need of review, from (predicted, category, confidence) (SUB-6)."""
    known = F.create_map(*[x for c in categories for x in (F.lit(c.lower()), F.lit(c))])
    out = df.withColumn("matched", F.try_element_at(known, F.lower(F.trim("predicted"))))
    out = out.withColumn("mismatch", F.coalesce(F.col("matched") != F.col("category"), F.lit(False)))
    return out.withColumn("needs_review", F.col("matched").isNull() | F.col("mismatch") | F.coalesce(F.col("confidence") < sure, F.lit(True)))


def extraction_text(fields: list[tuple[str, str]]) -> Column:
    """Labelled lines of the columns that hold something (SUB-8)."""
    line = lambda label, c: F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    return F.array_join(F.array_compact(F.array(*[line(label, c) for label, c in fields])), "\n")


def items_outside_claim(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Items that begin before the claim or, with their ``days``, end after it (SUB-9)."""
    met = items.join(claims.select("claim_id", "date_from", "date_to"), "claim_id")
    end = F.date_add("expense_date", F.greatest(F.coalesce("days", F.lit(1)), F.lit(1)) - 1)
    return met.withColumn("last_day", end).filter((F.col("expense_date") < F.col("date_from")) | (F.col("last_day") > F.col("date_to")))
