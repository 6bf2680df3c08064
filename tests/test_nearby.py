"""Receipts met where their vendor lies: the same results as by joins, each receipt sent once."""

from datetime import date, timedelta
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators import nearby, receipts

FIRST = date(2026, 1, 1)
WORDS = "receipt taxi hotel total amount paid card cash invoice number date city ride night".split()


def _fingerprints(spark, n=400):
    """Receipts of a large and some small vendors with every signal, nulls among them."""
    rng = np.random.default_rng(5)
    some = lambda x, share=0.1: None if rng.random() < share else x
    rows = []
    for k in range(n):
        vendor = "hot" if k % 2 else f"v{k % 14}"
        rows.append((
            1000 + 7 * k % n, some(int(rng.integers(n // 3)), 0.05), some(int(rng.integers(4)), 0.05), int(rng.integers(2)), some(vendor + "s" * (k % 5 == 0), 0.03), some(f"p{vendor}", 0.5) if k % 3 else None,
            some(FIRST + timedelta(int(rng.integers(60))), 0.03), f"{int(rng.integers(1, 6)) * 10 + int(rng.integers(2)) / 100:.2f}", some(f" INV-{int(rng.integers(4))}", 0.4),
            some(f"c{int(rng.integers(30))}"), some(f"{int(rng.integers(2**62)) if k % 3 else k % 2:016x}"), some(f"{int(rng.integers(3)):016x}"),
            some(" ".join(rng.choice(WORDS, int(rng.integers(0, 14))) if k % 5 else WORDS[: 2 + k % 3]) + ["", " É 12", "  X", "\t1.50"][k % 4]), some([float(x) for x in rng.normal(size=3)] if k % 29 else [0.0] * 3),
        ))
    schema = """item_id long, claim_id long, employee_id long, tenant int, vendor string, profile string, expense_date date, amount_usd string, invoice_number string, checksum string,
        image_hash string, difference_hash string, ocr_text string, embedding array<double>"""
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize(("amount", "whole_rows"), [("decimal(14,2)", 8192), ("decimal(14,2)", 60), ("double", 8192)])
def test_scan_is_that_by_joins(spark, amount, whole_rows):
    """All signals of vendors met in a task against those by joins, where every vendor counts as large."""
    fp = _fingerprints(spark).withColumn("amount_usd", F.col("amount_usd").cast(amount)).cache()
    plain = lambda v: sorted(v) if isinstance(v, list) else round(v, 5) if isinstance(v, float) else v
    want, got = ({r.item_id: {c: plain(v) for c, v in r.asDict().items()} for r in receipts.scan_duplicates(fp, n, 3).collect()} for n in (0, whole_rows))
    assert got == want and len(want) > 200
    flags = ",".join(r["flags"] for r in want.values())
    assert {x for x in receipts.FLAGS.values() if x not in flags} == set()


def test_scan_sends_a_receipt_once(spark):
    """the scan joined candidates, partners and splits, each with shuffles of all receipts."""
    plan = receipts.scan_duplicates(_fingerprints(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan


def test_scan_reads_vendors_over_batches(spark):
    """A vendor's receipts that come in several batches are whole."""
    fp = _fingerprints(spark, 120).withColumn("amount_usd", F.col("amount_usd").cast("decimal(14,2)")).cache()
    want = {tuple(map(str, r)) for r in receipts.scan_duplicates(fp).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {tuple(map(str, r)) for r in receipts.scan_duplicates(fp).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ratios_are_those_of_sequence_matcher(monkeypatch):
    """pairs were compared one by one; many at a time give the same ratios, also of long texts and of many characters."""
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list(letters), int(rng.integers(1, 70)))) for letters in ("ab", "abc d", "ab é中1 ", "taxi hotel 0123456789.") for _ in range(30)]
    texts += [f"uber trip {k % 3} meals {k}5.00 inv-{k % 7}" for k in range(20)] + ["x" * 64, "x" * 63 + "y", "ab" * 32, "ba" * 32, "x" * 65] + [chr(0x4E00 + k) * 3 + "ab" for k in range(300)]
    held = nearby.Texts(texts)
    some = np.r_[np.arange(145), rng.integers(145, len(texts), 40)]
    x, y = (a.ravel() for a in np.meshgrid(some, some))
    want = [SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio() for a, b in zip(x, y, strict=True)]
    assert held.ratios(x, y).tolist() == want and (held.bounds(x, y) >= np.array(want) - 1e-12).all()
    monkeypatch.setattr(nearby, "SequenceMatcher", None)  # short texts of few characters never need it
    few = nearby.Texts(texts[120:144])
    assert len(few.ratios(np.arange(24), np.arange(24)[::-1])) == 24


def test_best_ratio_of_rows():
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(WORDS[:5], 4)) for _ in range(60)]
    i, j = (a.ravel() for a in np.meshgrid(np.arange(60), np.arange(60), indexing="ij"))
    i, j = i[j < i], j[j < i]
    want = [max((SequenceMatcher(None, texts[a], t, autojunk=False).ratio() for t in texts[:a]), default=np.nan) for a in range(60)]
    assert np.array_equal(nearby.best_ratios(nearby.Texts(texts), i, j, 60), want, equal_nan=True)


def test_ocr_sends_a_receipt_once(spark):
    fp = _fingerprints(spark).drop("tenant", "embedding")
    plan = receipts.ocr_best(fp)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize(("block_rows", "parts"), [(1024, 1), (1024, 3), (3, 3)])
def test_embeddings_of_a_list(spark, block_rows, parts):
    """receipts carried their vectors; with a list of them in each task, and for vendors of any size, results are the same."""
    rng = np.random.default_rng(12)
    vectors = [(k, None if k % 11 == 0 else [0.0] * 8 if k % 13 == 0 else [float(x) for x in rng.normal(size=8)]) for k in range(90)]
    listed = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    fp = _fingerprints(spark).select("tenant", "item_id", "claim_id", "vendor", "expense_date", (F.col("item_id") % 100).alias("vec_id"))
    want = {r.item_id: round(r.embedding, 6) for r in receipts.embedding_signal(fp.join(listed, "vec_id")).collect()}
    found = receipts.embedding_signal(fp, block_rows=block_rows, parts=parts, vectors=listed)
    assert {r.item_id: round(r.embedding, 6) for r in found.collect()} == want and len(want) > 150
    if block_rows > 3:
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert receipts.embedding_signal(fp, parts=2, vectors=listed.limit(0)).isEmpty()
