"""Receipts that meet by spans of days: no pair lost, few rows sent twice."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators import duplicates as U
from quillet.operators import parsing, receipts

FIRST = date(2025, 12, 1)


def _receipts(spark, n=400):
    rng = np.random.default_rng(9)
    rows = [(k, int(rng.integers(60)), f"v{k % 3}", FIRST + timedelta(int(rng.integers(100))), int(rng.integers(4))) for k in range(n)]
    rows += [(900, None, "v1", FIRST, 1), (901, 1, None, FIRST, 1), (902, 1, "v1", None, 1)]
    return rows, spark.createDataFrame(rows, "item_id long, claim_id long, vendor string, expense_date date, kind int").repartition(3)


def _near(rows, days):
    whole = [r for r in rows if None not in r]
    return {(a[0], b[0]) for a in whole for b in whole if a[2] == b[2] and b[0] < a[0] and a[1] != b[1] and abs((a[3] - b[3]).days) <= days}


@pytest.mark.parametrize("days", [0, 1, 7])
def test_candidate_pairs_of_all_spans(spark, days):
    rows, fp = _receipts(spark)
    met = U.candidate_pairs(fp, days, carry=("vendor", "kind", "item_id")).collect()
    assert {(r.item_id, r.other_id) for r in met} == _near(rows, days) and len(met) == len(_near(rows, days))
    known = {r[0]: r for r in rows}
    assert all((x.vendor, x.kind, x.item_id) == (known[k][2], known[k][4], k) for r in met for x, k in ((r.a, r.item_id), (r.b, r.other_id)))


def test_few_rows_are_sent_twice(spark):
    _, near = U.spans(F.col("id").cast("int"), 7)
    assert spark.range(-3200, 3200).select(F.explode(near)).count() < 1.5 * 6400  # 3 times before
    fp = _receipts(spark)[1]
    plan = U.candidate_pairs(fp, carry=("vendor", "item_id", "expense_date", "kind"))._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct(vendor" not in plan.split("Join")[1]  # what pairs are found by goes through the join once


def test_packed_digests_keep_equality(spark):
    texts = ["a" * 64, "a" * 63 + "b", "A" * 64, "x" * 32, "", None, "\x01" + "\xaa" * 3]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(U.packed(F.col("t")).alias("p")).collect()]
    assert len({bytes(p) for p in got if p is not None}) == 6 and len(got[0]) == 33 and got[5] is None


def test_partners_without_an_owner_count_for_none(spark):
    rows = [(1, None, "v", FIRST, 1.0), (2, 5, "v", FIRST, 1.0), (3, 6, "v", FIRST, 1.01), (4, 5, "w", FIRST, 1.0), (5, None, "w", FIRST, 1.0)]
    fp = spark.createDataFrame(rows, "item_id long, employee_id long, vendor string, expense_date date, amount_usd double")
    assert {tuple(r) for r in U.cross_employee(fp).collect()} == {(2, 3, 1), (3, 2, 1)}


def test_best_signals_of_all_candidates(spark):
    rows, fp = _receipts(spark)
    hashes = {r[0]: f"{(r[4] + 1) * 0x9E3779B97F4A7C15 % 2**64:016x}" if r[0] % 7 else None for r in rows}
    full = fp.withColumns({"merchant_vendor": F.col("kind").cast("string"), "image_hash": F.create_map(*[F.lit(x) for k, h in hashes.items() if h for x in (k, h)])[F.col("item_id")]})
    want: dict = {}
    for a, b in _near(rows, 7):
        x, y = hashes[a], hashes[b]
        h = 1 - (int(x, 16) ^ int(y, 16)).bit_count() / 64 if x and y else None
        want.setdefault(a, set()).add(h)
    got = {r.item_id: r.hash for r in receipts.best_signals(full).collect()}
    assert got == {k: max((h for h in v if h is not None), default=None) for k, v in want.items()}


@pytest.mark.parametrize("block_rows", [1024, 5])
def test_ocr_best_over_all_candidates(spark, block_rows):
    """Every item's best ratio against that of all its candidates, in one cell and in squares of cells; no pair is a row."""
    rng = np.random.default_rng(3)
    words = "receipt taxi hotel total amount paid card cash invoice number date city ride night".split()
    rows, fp = _receipts(spark, 150)
    texts = {r[0]: None if r[0] % 9 == 0 else " ".join(rng.choice(words, int(rng.integers(0, 14)))) + ["", " É 12", "  X", "\t1.50"][r[0] % 4] for r in rows}
    full = fp.withColumn("ocr_text", F.create_map(*[F.lit(x) for k, t in texts.items() if t is not None for x in (k, t)])[F.col("item_id")])
    pairs = spark.createDataFrame(sorted(_near(rows, 7)), "item_id long, other_id long")
    want: dict = {}
    for r in pairs.select("item_id", "other_id").collect():
        x, y = (" ".join((texts[k] or "").lower().split()) for k in r)
        ratio = None if min(len(x), len(y)) < 8 else receipts.SequenceMatcher(None, x, y, autojunk=False).ratio()
        want.setdefault(r.item_id, []).append(ratio)
    found = receipts.ocr_best(full, block_rows=block_rows)
    assert {r.item_id: r.ocr for r in found.collect()} == {k: max((x for x in v if x is not None), default=None) for k, v in want.items()}
    assert "other_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_text_bounds_are_never_below_the_ratio():
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab é中1 "), int(rng.integers(1, 90)))) for _ in range(80)] + [chr(0x4E00 + k) * 9 for k in range(200)]
    x, y = (a.ravel() for a in np.meshgrid(np.arange(90), np.arange(90)))
    bounds = receipts.ratio_bounds(texts, x, y)
    ratios = [receipts.SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio() for a, b in zip(x, y, strict=True)]
    assert (bounds >= np.array(ratios) - 1e-12).all()


def test_csv_goes_on_by_megabytes(spark, monkeypatch):
    monkeypatch.setattr(parsing, "_FLUSH", 20)
    rows = [(k, None if k % 5 == 0 else f'"a{k}","b ""q"""\n , \nc,{k}') for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, t string").coalesce(1)
    seen = parsing.csv_to_text(df, "t")
    assert {(r.doc_id, r.t) for r in seen.collect()} == {(k, parsing.csv_lines(t)) for k, t in rows}
