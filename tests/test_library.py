"""Small cases of receipt signals, filters and candidate rules, the split search by brute force, and the transition stream."""

from datetime import date, timedelta
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators import documents as D
from quillet.operators import duplicates as U
from quillet.operators import library as L
from quillet.operators import receipts


def test_hash_and_text(spark):
    rows = spark.createDataFrame([("ffffffffffffffff", "fffffffffffffff0", "Uber  Trip 12", "uber trip 12"), ("8000000000000000", "0000000000000000", "short", "uber trip 12"), (None, "00", None, "x")], "a string, b string, s string, t string")
    out = rows.select(receipts.hash_similarity(F.col("a"), F.col("b")).alias("h"), receipts.text_ratio("s", "t").alias("r")).collect()
    assert [(r.h, r.r) for r in out] == [(1 - 4 / 64, 1.0), (1 - 1 / 64, None), (None, None)]


def test_splits_by_brute_force(spark):
    rows = [(k, 1, "v", f"2026-01-{1 + k % 9:02}", round(5.0 * (1 + k * 7 % 11), 2)) for k in range(14)] + [(99, 2, "v", "2026-01-01", 10.0)]
    items = spark.createDataFrame(rows, "item_id long, employee_id long, vendor string, d string, a double").selectExpr("item_id", "employee_id", "vendor", "cast(d as date) expense_date", "cast(a as decimal(14,2)) amount_usd")
    got = {r.item_id: r.parts for r in receipts.multi_receipt(items).collect()}
    want = {}
    for i, e, v, d, a in rows:
        near = sorted((y[3], y[0], y[4]) for y in rows if y[1:3] == (e, v) and y[0] != i and abs(int(y[3][-2:]) - int(d[-2:])) <= 7)[:12]
        fits = [c for n in range(2, len(near) + 1) for c in combinations(near, n) if abs(sum(x[2] for x in c) - a) <= 0.01 + 1e-9]
        if fits:
            want[i] = [x[1] for x in fits[0]]
    assert got == want and want


def test_subsets_by_brute_force():
    """Sums of halves against all subsets: equal amounts, zeros, empty slots, negative amounts, targets a cent off."""
    rng = np.random.default_rng(8)
    n = receipts.SIBLINGS
    cents = np.concatenate([rng.integers(-5, 8, (60, n)), rng.integers(1, 4, (20, n)), np.zeros((5, n), np.int64), rng.integers(0, 10**12, (40, n))])
    held = np.arange(n) < rng.integers(0, n + 1, len(cents))[:, None]
    cents = np.where(held, cents, 0)
    targets = np.array([int(c[rng.permutation(n)[:3]].sum()) + int(rng.integers(-2, 3)) for c in cents])
    want = []
    for c, t, h in zip(cents, targets, held, strict=True):
        fits = (k for k, some in enumerate(receipts._SUBSETS) if all(h[j] for j in some) and abs(int(sum(c[j] for j in some)) - t) <= 1)
        want.append(next(fits, -1))
    assert list(receipts.subsets(cents, targets, held)) == want and -1 in want and max(want) > 100
    assert list(receipts.subsets(cents[:0], targets[:0], held[:0])) == []


def test_near_duplicate(spark):
    df = spark.createDataFrame([(1, 0.9, None), (0, 0.9, 0.5), (0, 0.5, None), (None, None, None)], "exact int, hash double, invoice double")
    assert [r.near for r in receipts.near_duplicate(df, ["hash", "invoice"]).collect()] == [None, 0.9, 0.0, None]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, None), (3, "b", ["y"])], "id long, c string, tags array<string>")
    ask = lambda *f: [r.id for r in df.filter(L.compile_filters(list(f), {"c": "c", "tags": "tags"}, ("tags",))).collect()]
    assert ask(("c", "ne", "a")) == [2, 3] and ask(("c", "nin", ["a"])) == [2, 3] and ask(("c", "in", ["a"])) == [1] and ask(("c", "exists", False)) == [2]
    assert ask(("tags", "contains", "y")) == [3] and ask(("c", "gt", "a")) == [3] and ask() == [1, 2, 3]
    for bad in (("d", "eq", 1), ("c", "like", 1), ("c", "in", [])):
        with pytest.raises(ValueError):
            ask(bad)


def test_candidates(spark):
    rules = spark.createDataFrame([(1, 1, "Meal", "s" * 200, "x", 1), (1, 1, " meal", "s" * 170, "xxx", 2), (1, 2, "Meal", "s", "x", 3)], "doc_id long, page int, name string, source string, body string, position int")
    assert sorted((r.position, r.first_place) for r in L.dedup_candidates(rules).collect()) == [(2, 1), (3, 3)]
    one = spark.createDataFrame([(["A"], ["b"], None, [], "src", 0.9), (None, None, None, ["n"], "src", 0.9)], "special_rules array<string>, exclusions array<string>, documents array<string>, notes array<string>, source string, confidence double")
    assert [(r.needs_review, r.special_rules) for r in L.review_candidates(one.withColumn("exclusions", F.array(F.lit("b"), F.lit("B")))).collect()] == [(False, ["A", "Excluded: b"]), (True, ["Excluded: b"])]
    entries = spark.createDataFrame([("k", "b", True), ("k", "a", True), ("k", "c", False)], "kind string, name string, is_active boolean")
    assert [(r.entries, r.names) for r in L.active_by_kind(entries).collect()] == [(2, "a,b")]


def test_clean_sections_and_language(spark):
    rows = [(1, k, f"Head er\nthe policy and the employee {k}\n{k + 1}") for k in range(4)] + [(2, 0, "der die das und"), (2, 1, None), (3, 0, "Page 3")]
    sections = spark.createDataFrame(rows, "doc_id long, section int, text string")
    cleaned = {(r.doc_id, r.section): r.text for r in D.clean_sections(sections).collect()}
    assert cleaned == {(1, k): f"the policy and the employee {k}" for k in range(4)} | {(2, 0): "der die das und"}
    assert {r.doc_id: r.language for r in D.document_language(sections).collect()} == {1: "en", 2: "de", 3: None}


@pytest.mark.parametrize("block_rows", [1024, 3])
def test_embedding_signal(spark, block_rows):
    """Blocks of receipts against the cosines of all candidate pairs; a vendor with most of the receipts."""
    rng = np.random.default_rng(4)
    first = date(2026, 1, 1)
    rows = [(k, int(rng.integers(30)), "hot" if k % 3 else f"v{k % 5}", first + timedelta(int(rng.integers(40))), None if k % 17 == 0 else [float(x) for x in rng.normal(size=6)]) for k in range(160)]
    rows += [(900, None, "hot", first, [1.0] * 6), (901, 1, None, first, [1.0] * 6), (902, 1, "hot", None, [1.0] * 6), (903, 77, "hot", first, [0.0] * 6)]
    fp = spark.createDataFrame(rows, "item_id long, claim_id long, vendor string, expense_date date, embedding array<double>").repartition(3)
    known, want = {r[0]: r for r in rows}, {}
    for r in U.candidate_pairs(fp).collect():
        a, b = known[r.item_id][4], known[r.other_id][4]
        if a and b:
            n = np.linalg.norm(a) * np.linalg.norm(b)
            want[r.item_id] = max(want.get(r.item_id, -2.0), float(np.dot(a, b) / n) if n else 0.0)
    got = {r.item_id: r.embedding for r in receipts.embedding_signal(fp, block_rows=block_rows).collect()}
    assert got == pytest.approx(want) and len(want) > 50
    plan = receipts.embedding_signal(fp)._jdf.queryExecution().executedPlan().toString()
    assert "item_id, other_id" not in plan


def test_ocr_bounds_never_lose_the_best(spark):
    """The best ratio of every item over all its candidates, though few pairs are compared."""
    rng = np.random.default_rng(6)
    words = "receipt taxi hotel total amount paid card cash invoice number date city ride night".split()
    texts = {k: " ".join(rng.choice(words, int(rng.integers(0, 9)))) + rng.choice(["", " É 12", "  X", "\t1.50"]) for k in range(120)}
    texts[7] = texts[3].upper() if len(texts[3]) > 8 else "a receipt of its own"
    fp = spark.createDataFrame([*texts.items(), (500, None)], "item_id long, ocr_text string")
    every = [(a, b) for a in texts for b in texts if b < a and (a - b) < 30] + [(500, 1)]
    want: dict = {}
    plain = lambda t: " ".join((t or "").lower().split())
    for a, b in every:
        x, y = plain(texts.get(a)), plain(texts[b])
        r = None if min(len(x), len(y)) < receipts.LEAST_TEXT else SequenceMatcher(None, x, y, autojunk=False).ratio()
        want[a] = max((v for v in (want.get(a), r) if v is not None), default=None)
    pairs = spark.createDataFrame(every, "item_id long, other_id long")
    assert {r.item_id: r.ocr for r in receipts.ocr_signal(fp, pairs).collect()} == pytest.approx(want)
    sides = fp.select("item_id", receipts.plain_text(F.col("ocr_text")).alias("t")).filter(F.length("t") > 0)
    sides = sides.select("item_id", "t", F.length("t").alias("n"), receipts._counts("t").alias("counts"))
    both = U.with_both(sides, pairs).select("a.t", F.col("b.t").alias("u"), receipts.ratio_bound("a", "b").alias("bound"))
    assert all(SequenceMatcher(None, r.t, r.u, autojunk=False).ratio() <= r.bound + 1e-12 for r in both.collect())


def test_verdict_of_a_hot_vendor(spark):
    """An identical receipt of the item's own day stays found behind 250 later ones."""
    rows = [(1, 1, "Hot", "2026-01-05", 90.0, "N1")] + [(k, k, "Hot", "2026-01-08", float(k), f"X{k}") for k in range(2, 252)] + [(999, 999, "Hot", "2026-01-05", 90.0, "N1")]
    items = spark.createDataFrame(rows, "item_id long, claim_id long, merchant_vendor string, d string, a double, invoice_number string")
    fp = U.with_keys(items.selectExpr("item_id", "claim_id", "merchant_vendor", "cast(d as date) expense_date", "cast(a as decimal(14,2)) amount_usd", "invoice_number"))
    last = U.verdict(U.pair_signals(fp, U.candidate_pairs(fp))).filter("item_id = 999").first()
    assert (last.exact, last.invoice, last.candidates, last.verdict) == (1, 1.0, 251, "CONFIRMED")
    assert U.candidate_pairs(fp, newest=200).filter("item_id = 999").count() == 200


def test_document_language_reads_each_section_once(spark):
    """No filter repeats the detection below the votes; documents whose sections decide nothing go by their whole text."""
    text = {1: ["the expense of the employee", "der die das und von", "der die das und von mit nicht"], 2: ["xyzzy plugh xyzzy", "the and"], 3: ["the", "and of", "to for is"], 4: ["plugh xyzzy plugh"]}
    rows = [(d, k, t) for d, ts in text.items() for k, t in enumerate(ts)]
    out = D.document_language(spark.createDataFrame(rows, "doc_id long, section long, text string"))
    assert {r.doc_id: r.language for r in out.collect()} == {1: "de", 2: "en", 3: "en", 4: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "regexp" in line for line in plan.splitlines())
