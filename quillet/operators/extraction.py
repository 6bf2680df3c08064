"""What extractors return, as columns: expense responses, extraction summaries and candidate rules (SUB-2, SUB-7, POL-16, POL-17, POL-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Currency symbols in the order in which they are tried, and codes that are taken from a text.
SYMBOLS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"))
CODES = ("USD", "EUR", "GBP", "JPY", "INR", "AUD", "CAD", "CHF", "CNY", "SGD", "NZD", "HKD", "AED")
#: Field types and the names that their confidence goes by.
FIELD_NAMES = {"VENDOR_NAME": "vendor", "TOTAL": "total", "INVOICE_RECEIPT_DATE": "date", "SUBTOTAL": "subtotal", "TAX": "tax"}
#: Categories of candidate rules, and texts that say nothing.
RULE_CATEGORIES = ("meals", "travel", "lodging", "entertainment", "flights", "ground_transport", "client_entertainment", "other")
NOTHING = ("null", "none", "n/a", "not stated", "not specified")
#: What a number in a text looks like, words that announce a limit, and words that qualify a rule.
NUMBER = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?"
LIMIT_WORDS = r"(?i)(?:up to|maximum|max\.?|not exceed|limit(?:ed)? to|capped)"
QUALIFIERS = r"(?i)\b(?:except|exception|however|provided that|unless|subject to|notwithstanding)\b"
WINDOW_CHARS, OVERLAP_CHARS = 9_000, 800
_TEXT = "struct<Text:string>"
_FIELD = f"struct<Type:{_TEXT},LabelDetection:{_TEXT},ValueDetection:struct<Text:string,Confidence:double>>"
_RESPONSE = (
    f"struct<ExpenseDocuments:array<struct<SummaryFields:array<{_FIELD}>,"
    f"LineItemGroups:array<struct<LineItems:array<struct<LineItemExpenseFields:array<{_FIELD}>>>>>>>>"
)
_DATES = ("yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "dd.MM.yyyy", "d MMMM, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _at(rows: Column, k: int) -> Column:
    return F.try_element_at(rows, F.lit(k))


def to_number(text: Column) -> Column:
    """The number in a text of digits, points and signs among other characters; null where they make none."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def to_date(text: Column) -> Column:
    """The day in a text, by the first of the usual forms that fits the whole of it."""
    bare = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(form)).cast("date") for form in _DATES])


def parse_expense_response(df: DataFrame, json: str) -> DataFrame:
    """Adds fields, summary and line_items from a nested extractor response (SUB-7).

    The first value of a type counts in the summary, the last one in a line item.
    Items are numbered within their document.  A response that is no JSON gives
    empty arrays and nulls.
    """
    read = df.withColumn("_docs", F.coalesce(F.from_json(json, _RESPONSE)["ExpenseDocuments"], F.from_json(F.lit('{"ExpenseDocuments":[]}'), _RESPONSE)["ExpenseDocuments"]))
    fields = F.flatten(F.filter(F.transform("_docs", lambda d: d["SummaryFields"]), lambda s: s.isNotNull()))
    field = lambda f: F.struct(
        f["Type"]["Text"].alias("type"), f["LabelDetection"]["Text"].alias("label"), f["ValueDetection"]["Text"].alias("value"),
        F.round(f["ValueDetection"]["Confidence"], 2).alias("confidence"),
    )
    read = read.withColumn("fields", F.transform(fields, field))
    said = F.filter("fields", lambda f: (f["type"] != "") & (f["value"] != ""))
    seen = F.transform(said, lambda f: f["type"])
    read = read.withColumn("_first", F.filter(said, lambda f, k: F.array_position(seen, f["type"]) == k + 1))
    of = lambda name: _at(F.filter("_first", lambda f: f["type"] == name), 1)["value"]
    day = _at(F.filter("_first", lambda f: F.contains(f["type"], F.lit("DATE"))), 1)["value"]

    def currency(f: Column) -> Column:
        code = F.regexp_extract(f["value"], r"\b([A-Z]{3})\b", 1)
        out = F.lit(None).cast("string")
        for symbol, name in reversed(SYMBOLS):
            out = F.when(F.contains(f["value"], F.lit(symbol)), name).otherwise(out)
        return F.when(code.isin(*CODES), code).otherwise(out)

    inferred = _at(F.filter(F.transform("_first", currency), lambda c: c.isNotNull()), 1)
    summary = F.struct(
        F.coalesce(of("VENDOR_NAME"), of("NAME")).alias("vendor_name"), day.alias("transaction_date"),
        to_number(of("TOTAL")).alias("total_amount"), F.coalesce(of("CURRENCY"), inferred).alias("currency"),
    )

    def item(row: Column, k: Column) -> Column:
        last = lambda name: _at(F.filter(row, lambda f: f["Type"]["Text"] == name), -1)["ValueDetection"]["Text"]
        either = lambda a, b: F.coalesce(_filled(last(a)), last(b))
        return F.struct(
            (k + 1).alias("line_number"), either("ITEM", "EXPENSE_ROW").alias("description"), to_number(last("QUANTITY")).alias("quantity"),
            to_number(either("UNIT_PRICE", "PRICE")).alias("unit_price"), to_number(either("PRICE", "AMOUNT")).alias("amount"),
        )

    def items(doc: Column) -> Column:
        groups = F.filter(F.transform(doc["LineItemGroups"], lambda g: g["LineItems"]), lambda x: x.isNotNull())
        return F.transform(F.transform(F.flatten(groups), lambda x: x["LineItemExpenseFields"]), item)

    listed = F.flatten(F.filter(F.transform("_docs", items), lambda x: x.isNotNull()))
    return read.withColumns({"summary": summary, "line_items": listed}).drop("_docs", "_first")


def summarize_extraction(df: DataFrame, json: str) -> DataFrame:
    """Adds vendor, transaction_date, total_amount, currency and confidences from either extractor's shape (SUB-2).

    A value of the summary comes before one at the top.  Confidences are from 0 to 100;
    an overall one up to 1 is taken as a share.  Dates in unknown forms are null.
    """
    get = lambda path: _filled(F.get_json_object(json, f"$.{path}"))
    either = lambda name: F.coalesce(get(f"summary.{name}"), get(name))
    scores = F.from_json(F.get_json_object(json, "$.summary.fields"), "array<struct<fieldType:string,confidence:double>>")
    names = F.create_map(*[F.lit(x) for pair in FIELD_NAMES.items() for x in pair])
    name = lambda f: F.coalesce(F.try_element_at(names, F.upper(f["fieldType"])), F.lower(f["fieldType"]))
    own = F.transform(F.filter(scores, lambda f: f["confidence"].isNotNull() & (f["fieldType"] != "")), lambda f: F.struct(name(f).alias("field"), F.round(f["confidence"], 2).alias("confidence")))
    overall = get("confidenceScore").try_cast("double")
    whole = F.when(overall.isNotNull(), F.array(F.struct(F.lit("overall").alias("field"), F.round(F.when(overall <= 1, overall * 100).otherwise(overall), 2).alias("confidence"))))
    none = F.from_json(F.lit("[]"), "array<struct<field:string,confidence:double>>")
    return df.withColumns(
        {
            "vendor": F.trim(either("vendorName")),
            "transaction_date": to_date(either("transactionDate")),
            "total_amount": F.coalesce(get("summary.totalAmount"), get("totalAmount")).try_cast("double"),
            "currency": F.substring(F.upper(F.trim(either("currency"))), 1, 3),
            "confidences": F.concat(F.coalesce(own, none), F.coalesce(whole, none)),
        }
    )


def window_text(df: DataFrame, text: str, width: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Adds windows: overlapping stretches of whole paragraphs, of about ``width`` characters (POL-16).

    A longer paragraph is cut at its last blank in the second half of a window, or at
    the window's end.  Each window but the first begins with the end of the one before.
    """
    bare = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    cut = rf"(?sU)\s*(.{{1,{width}}}\z|.{{{width // 2 + 1},{width - 1}}}(?= )|.{{{width}}})"
    split = F.filter(F.transform(F.split(bare, r"(?U)\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    pieces = F.flatten(F.transform(split, lambda p: F.transform(F.regexp_extract_all(p, F.lit(cut), F.lit(1)), lambda x: F.trim(x))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, p: Column) -> Column:
        # The room that a window counts for a paragraph includes the blank line after it; a tail has none.
        used = F.length(s["now"]) + F.when(F.size(s["done"]) == 0, 2).otherwise(0 if overlap else 2)
        full = (s["now"] != "") & (used + F.length(p) + 2 > width)
        tail = F.right(s["now"], F.lit(overlap)) if overlap else F.lit("")
        joined = lambda head: F.when(head == "", p).otherwise(F.concat(head, F.lit("\n\n"), p))
        return F.when(full, F.struct(F.array_append(s["done"], s["now"]).alias("done"), joined(tail).alias("now"))).otherwise(
            F.struct(s["done"].alias("done"), joined(s["now"]).alias("now"))
        )

    folded = F.aggregate(pieces, start, add, lambda s: F.array_append(s["done"], s["now"]))
    return df.withColumn("windows", F.when(F.length(bare) <= width, F.array(bare)).otherwise(folded))


def parse_rules(df: DataFrame, raw: str) -> DataFrame:
    """Adds rules: the rule objects in a model's answer, each as JSON (POL-17).

    Tried in turn: the answer, its fenced block, its widest span of braces; each as it is
    and without commas before a closing bracket.  The rules are the list under
    ``rules``, the list itself, or an object that has a name.
    """
    text = F.trim(F.col(raw))
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.+?)\s*```", 1)
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    tries = [t for c in (text, fenced, span) for t in (c, F.regexp_replace(c, r",\s*([}\]])", "$1"))]
    read = df.withColumn("_v", F.coalesce(*[F.try_parse_json(_filled(t)) for t in tries]))
    kind = F.schema_of_variant("_v")
    listed = F.try_variant_get("_v", "$.rules", "array<variant>")
    alone = F.when(F.try_variant_get("_v", "$.name", "string") != "", F.array("_v"))
    rules = F.when(kind.startswith("ARRAY"), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.coalesce(listed, alone))
    objects = F.transform(F.filter(rules, lambda r: F.schema_of_variant(r).startswith("OBJECT")), lambda r: F.to_json(r))
    return read.withColumn("rules", F.coalesce(objects, F.array().cast("array<string>"))).drop("_v")


def stated_amount(text: Column) -> Column:
    """The only number in a text, if there is one and it is not negative."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    value = F.regexp_replace(_at(found, 1), ",", "").try_cast("decimal(18,4)")
    return F.when((F.size(found) == 1) & (value >= 0), value)


def said(text: Column, width: int) -> Column:
    """A text trimmed and cut to a width; null where it says nothing."""
    bare = F.trim(text)
    return F.when((bare != "") & ~F.lower(bare).isin(*NOTHING), F.trim(F.substring(bare, 1, width)))


def once_each(texts: Column, width: int = 1_000, most: int = 60) -> Column:
    """Texts that say something, each once whatever its case, in order."""
    kept = F.filter(F.transform(texts, lambda x: said(x, width)), lambda x: x.isNotNull())
    lower = F.transform(kept, lambda x: F.lower(x))
    return F.slice(F.filter(kept, lambda x, k: F.array_position(lower, F.lower(x)) == k + 1), 1, most)


def share_of_one(text: Column) -> Column:
    """A confidence between 0 and 1 with three places; above 1 it is a percentage."""
    value = F.regexp_replace(F.trim(text), "%+$", "").try_cast("decimal(18,6)")
    return F.greatest(F.lit(0), F.least(F.lit(1), F.when(value > 1, value / 100).otherwise(value))).cast("decimal(4,3)")


def clean_candidates(df: DataFrame) -> DataFrame:
    """Candidate rules with clean fields and what a reviewer should know (POL-19).

    ``df`` has the model's answers as strings (name, category, expense_limit,
    limit_expression, receipt_required_above, country, currency, grade_tier, source_text,
    description, priority, overall_confidence, review_notes) and lists (special_rules,
    exclusions).  Rows without a name or category are left out.
    """
    named = df.filter(said(F.col("name"), 200).isNotNull() & said(F.col("category"), 64).isNotNull())
    category = F.regexp_replace(F.lower(said(F.col("category"), 64)), "[ -]", "_")
    country, currency = F.upper(said(F.col("country"), 64)), F.upper(F.regexp_replace(said(F.col("currency"), 16), "[^A-Za-z]", ""))
    made = named.withColumns(
        {
            "_asked": F.struct("category", "country", "currency", "source_text"),
            "name": said(F.col("name"), 200),
            "category": F.when(category.isin(*RULE_CATEGORIES), category).otherwise("other"),
            "country": F.when(country.rlike("^[A-Z]{2}$"), country),
            "currency": F.when(currency.rlike("^[A-Z]{3}$"), currency),
            "expense_limit": stated_amount(F.col("expense_limit")),
            "limit_expression": said(F.col("limit_expression"), 500),
            "receipt_required_above": stated_amount(F.col("receipt_required_above")),
            "grade_tier": said(F.col("grade_tier"), 64),
            "source_text": F.coalesce(said(F.col("source_text"), 8_000), said(F.col("description"), 2_000)),
            "special_rules": once_each(F.col("special_rules")),
            "exclusions": once_each(F.col("exclusions")),
            "priority": F.coalesce(F.when(F.col("priority").try_cast("int") != 0, F.col("priority").try_cast("int")), F.lit(100)),
            "overall_confidence": share_of_one(F.col("overall_confidence")),
            "_known": category.isin(*RULE_CATEGORIES),
        }
    )
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    clause = F.coalesce("source_text", F.lit(""))
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    bare = (count("special_rules") <= 0) & (count("exclusions") <= 0)
    notes = F.array_compact(
        F.array(
            said(F.col("review_notes"), 4_000),
            F.when(~F.col("_known"), "CATEGORY_NOT_IN_LIST"),
            F.when(said(F.col("_asked.source_text"), 8_000).isNull(), "SOURCE_IS_PARAPHRASE"),
            F.when(there("_asked.country") & F.col("country").isNull(), "COUNTRY_DROPPED"),
            F.when(there("_asked.currency") & F.col("currency").isNull(), "CURRENCY_DROPPED"),
            F.when(~there("_asked.currency") & F.col("currency").isNull(), "CURRENCY_NOT_STATED"),
            F.when(F.col("expense_limit").isNull() & F.col("limit_expression").isNull() & clause.rlike(LIMIT_WORDS), "LIMIT_MISSED"),
            F.when(bare & clause.rlike(QUALIFIERS), "QUALIFIER_MISSED"),
            F.when(F.col("overall_confidence").isNull(), "NO_CONFIDENCE"),
        )
    )
    return made.withColumn("notes", notes).drop("_asked", "_known")
