"""Vendors, duplicate receipts and duplicate items (VEN-*, DUP-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import cut

WINDOW_DAYS = 7
CLOSED = ("Rejected", "Withdrawn")


def normalize_vendor(vendor: Column) -> Column:
    """Trimmed, lower case, single spaces (VEN-1)."""
    return F.lower(F.trim(F.regexp_replace(vendor, r"\s+", " ")))


def _tenant(df: DataFrame) -> list[str]:
    """The key that parts tenants, where a table has one."""
    return [c for c in df.columns if c == "tenant"]


def vendor_stats(items: DataFrame) -> DataFrame:
    """Claims, spend, first and last day per vendor (VEN-3)."""
    return items.groupBy(*_tenant(items), normalize_vendor(F.col("merchant_vendor")).alias("vendor")).agg(
        F.countDistinct("claim_id").alias("claims"), F.count("*").alias("items"), F.sum("amount_usd").alias("spend_usd"),
        F.min("expense_date").alias("first_seen"), F.max("expense_date").alias("last_seen"),
    )


def checksum() -> Column:
    """Stands for the receipt's digest: equal vendor, amount and day give equal receipts."""
    return F.sha2(F.concat_ws("|", normalize_vendor(F.col("merchant_vendor")), F.col("amount_usd").cast("string"), F.col("expense_date").cast("string")), 256)


def with_keys(items: DataFrame) -> DataFrame:
    return items.withColumns({"vendor": normalize_vendor(F.col("merchant_vendor")), "checksum": checksum()})


def packed(digest: Column) -> Column:
    """A digest of 64 hex digits as its 32 bytes, any other text as its own; equal only where the texts are."""
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.concat(F.unhex(F.lit("01")), F.unhex(digest))).otherwise(F.concat(F.unhex(F.lit("00")), digest.cast("binary")))


#: A span is so many times as long as a window and a day.
SPAN = 4


def spans(day: Column, days: int) -> tuple[Column, Column]:
    """A day's own span, and all spans that have a day at most ``days`` away; null for no day."""
    width = SPAN * (days + 1)
    own, into = F.floor(day / width), F.pmod(day, F.lit(width))
    beside = F.array(own, F.when(into < days, own - 1), F.when(into >= width - days, own + 1))
    return own, F.array_compact(beside)


def candidate_pairs(fp: DataFrame, days: int = WINDOW_DAYS, newest: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, other_id): same vendor, days apart at most, other claim, seen earlier (DUP-1).

    With ``carry`` the pairs bring these columns of both sides as structs a and b, so that no pair is shuffled
    to fetch them; what the pairs are found by is not shuffled a second time.

    All of them, as signals and verdicts need; ``newest`` keeps an item's so many newest partners.

    A range join made an equi-join: each item is filed under the span of ``SPAN`` windows that
    holds its date, its partner under that span and, near its ends, the neighbour, so a
    vendor is split by date, only near rows meet, and few are sent twice.
    """
    keys = _tenant(fp) + ["vendor"]
    own_span, near_spans = spans(F.datediff("expense_date", F.lit("1970-01-01")), days)
    sent = list(dict.fromkeys(["item_id", "claim_id", "expense_date", *[c for c in carry if c not in keys]]))
    own = fp.select(*keys, *sent, own_span.alias("_span"))
    near = fp.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in sent], F.explode(near_spans).alias("_span"))
    apart = F.abs(F.datediff("expense_date", "_b_expense_date"))
    met = own.join(near, [*keys, "_span"]).filter((apart <= days) & (F.col("_b_item_id") < F.col("item_id")) & (F.col("claim_id") != F.col("_b_claim_id")))
    side = lambda to, p: [F.struct(*[F.col(c if c in keys else p + c).alias(c) for c in carry]).alias(to)] if carry else []
    pairs = met.select("item_id", F.col("_b_item_id").alias("other_id"), F.col("_b_expense_date").alias("_date"), *side("a", ""), *side("b", "_b_"))
    if newest is None:
        return pairs.drop("_date")
    rank = W.partitionBy("item_id").orderBy(F.desc("_date"), F.desc("other_id"))
    return pairs.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= newest).drop("_n", "_date")


def invoice_similarity(a: str, b: str) -> Column:
    """Weighted agreement of vendor, day, amount and, if both have one, number (DUP-8)."""
    col = lambda side, name: F.col(f"{side}.{name}")
    same = lambda name: F.when(col(a, name) == col(b, name), 1.0).otherwise(0.0)
    amount = F.when(F.abs(col(a, "amount_usd") - col(b, "amount_usd")) <= 0.01, 1.0).otherwise(0.0)
    base = 0.35 * same("vendor") + 0.15 * same("expense_date") + 0.15 * amount
    both = col(a, "invoice_number").isNotNull() & col(b, "invoice_number").isNotNull()
    number = F.when(F.lower(F.trim(col(a, "invoice_number"))) == F.lower(F.trim(col(b, "invoice_number"))), 1.0).otherwise(0.0)
    return F.when(both, base + 0.35 * number).otherwise(base / 0.65)


def with_both(fp: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the rows of both sides as structs a and b; pairs that carry them stay as they are."""
    if {"a", "b"} <= set(pairs.columns):
        return pairs
    mine = fp.select(F.struct(*fp.columns).alias("a"), "item_id")
    other = fp.select(F.struct(*fp.columns).alias("b"), F.col("item_id").alias("other_id"))
    return pairs.join(mine, "item_id").join(other, "other_id")


#: What ``pair_signals`` reads of both sides.
SIGNAL_COLUMNS = ("checksum", "vendor", "expense_date", "amount_usd", "invoice_number")


def pair_signals(fp: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best exact and invoice signal per item over its candidates (DUP-2, DUP-8)."""
    scored = with_both(fp, pairs).select(
        "item_id",
        F.when(F.col("a.checksum").isNotNull(), (F.col("a.checksum") == F.col("b.checksum")).cast("int")).alias("exact"),
        invoice_similarity("a", "b").alias("invoice"),
    )
    return scored.groupBy("item_id").agg(F.max("exact").alias("exact"), F.round(F.max("invoice"), 6).alias("invoice"), F.count("*").alias("candidates"))


def verdict_name(score: Column) -> Column:
    return F.when(score >= 0.95, "CONFIRMED").when(score >= 0.75, "LIKELY").when(score > 0, "POSSIBLE").otherwise("NO_MATCH")


def verdict(signals: DataFrame) -> DataFrame:
    """Highest fired signal and its verdict; null means not applicable (DUP-12)."""
    fired = F.greatest(F.when(F.col("exact") == 1, 1.0), F.when(F.col("invoice") >= 0.9, F.col("invoice")), F.lit(0.0))
    return signals.withColumn("score", fired).withColumn("verdict", verdict_name(F.col("score")))


def partners(rows: DataFrame, keys: list[str], own: str, near: str | None = None) -> DataFrame:
    """(item_id, first_id, links): of the rows that share ``keys`` and differ in ``own``, the least item and their number.

    One row per item that has a partner, never pairs: classes are counted per owner
    first, so a window sees a row per owner, and each item looks up its owner's.  ``near``, an integer key, may differ by
    one: an owner's rows then count for the values below and above, too; rows are then dealt by ``keys`` once, and counted
    and spread where they lie.  Rows without a key or an owner meet none.
    """
    by = keys if near is None else [*keys, near]
    rows = rows.dropna(subset=[*by, own])
    rows = cut(rows) if near is None else rows.repartition(*keys)  # narrow, and read twice
    owners = rows.groupBy(*by, own).agg(F.min("item_id").alias("_m"), F.count("*").alias("_k"))
    if near is not None:
        spread = owners.withColumn(near, F.explode(F.array(F.col(near) - 1, F.col(near), F.col(near) + 1)))
        owners = spread.groupBy(*by, own).agg(F.min("_m").alias("_m"), F.sum("_k").alias("_k"))
    whole = W.partitionBy(*by)
    ordered = whole.orderBy("_m")
    # The first row of a class looks to the second, all others to the first.
    first = F.when(F.row_number().over(ordered) == 1, F.lead("_m").over(ordered)).otherwise(F.min("_m").over(whole))
    met = owners.withColumns({"first_id": first, "links": F.sum("_k").over(whole) - F.col("_k")})
    found = met.filter("first_id IS NOT NULL").select(*by, own, "first_id", "links")
    return rows.join(found, [*by, own]).select("item_id", "first_id", "links")


def cross_employee(fp: DataFrame) -> DataFrame:
    """(item_id, first_id, links): other employees' items of one vendor and day, amounts a cent apart at most (DUP-9).

    An item is late if first_id is below its own.
    """
    keys = _tenant(fp) + ["vendor", "expense_date"]
    rows = fp.select("item_id", "employee_id", *keys, F.round(F.col("amount_usd") * 100).cast("long").alias("cents"))
    return partners(rows, keys, "employee_id", near="cents")


def duplicate_items(items: DataFrame) -> DataFrame:
    """(item_id, first_id, links): same employee, day, vendor and amount on other claims, rejected items left out (DUP-14)."""
    live = items.filter(~F.coalesce(F.col("status").isin(*CLOSED), F.lit(False)))
    keys = _tenant(live) + ["employee_id", "expense_date", "vendor", "amount_usd"]
    return partners(live.select("item_id", "claim_id", *keys), keys, "claim_id")


def same_day_vendor(items: DataFrame) -> DataFrame:
    """Groups of two items or more of one employee, vendor and day (DUP-15)."""
    return items.groupBy("employee_id", "vendor", "expense_date").agg(F.count("*").alias("items"), F.sum("amount_usd").alias("total_usd")).filter("items > 1")


def same_file_hash(items: DataFrame, parts: int | None = None) -> DataFrame:
    """Receipts that more than one claim uses (DUP-16); ``parts`` is the number of tasks that checksums are dealt to."""
    if parts is not None:
        items = items.repartition(parts, "checksum")
    return items.groupBy("checksum").agg(F.countDistinct("claim_id").alias("claims"), F.min("item_id").alias("first_item"), F.count("*").alias("items")).filter("claims > 1")
