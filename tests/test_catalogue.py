"""Small cases and brute force for what SQL twins leave open: edges, windows, recall, scopes."""

import math
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import documents as D
from quillet.operators import duplicates as U
from quillet.operators import extraction as X
from quillet.operators import knowledge, lifecycle, policy, receipts, vendors
from quillet.operators import vectors as V
from quillet.plans import registry
from quillet.sources import tables

FOLDER = "/root/testdata/sf0.001"


def test_items_stay_without_rules(spark):
    items, rules = tables.expense_items(spark, FOLDER), policy.seed_rules(spark)
    n = items.count()
    for left in (rules.filter("category <> '*'"), rules.filter("category = '*'"), rules.limit(0)):
        assert policy.rules_as_of(items, left).count() == n
    without = policy.rules_as_of(items, rules.filter("category <> '*'"))
    assert without.filter("age_limit IS NOT NULL").isEmpty() and not without.filter("code IS NOT NULL").isEmpty()
    assert policy.evaluate_expense_policy(items, rules.filter("category <> '*'")).count() == n


def test_age_limit_is_that_in_force(spark):
    items = tables.expense_items(spark, FOLDER)
    rules = policy.seed_rules(spark)
    retired = rules.withColumn("is_active", F.col("category") != "*")
    assert policy.rules_as_of(items, retired).filter("age_limit IS NOT NULL").isEmpty()
    assert policy.rules_as_of(items, retired, include_retired=True).filter("age_limit = 90").count() == items.count()
    dated = rules.filter("category = '*'").selectExpr("* EXCEPT (effective_to)", "DATE '2025-12-01' AS effective_to").unionByName(
        rules.filter("category = '*'").selectExpr("* EXCEPT (actions, conditions, effective_from, version)", "'{}' AS actions", """'{"submissionAgeDays": {"lte": 30}}' AS conditions""", "DATE '2025-12-02' AS effective_from", "2 AS version")
    )
    got = policy.rules_as_of(items, dated).select("age_limit", (F.col("ruleset_date") <= "2025-12-01").alias("old")).distinct().collect()
    assert {(r.age_limit, r.old) for r in got} <= {(90.0, True), (30.0, False)} and len(got) > 0


def test_receipts_that_say_what_they_hold(spark):
    said = ['{"prohibitedItems": ["Alco-hol"]}', '{"hasAlcohol": true}', '{"containsAlcohol": "yes"}', '{"alcohol": 2}', '{"hasAlcohol": false}', '{"alcohol": ""}', '{"alcohol": 0}', '{"alcoholic": true}', None, "no json"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, extracted_receipt string")
    got = df.select("k", F.coalesce(F.array_contains(policy.receipt_items(), "alcohol"), F.lit(False)).alias("hit")).orderBy("k").collect()
    assert [r.hit for r in got] == [True, True, True, True, False, False, False, False, False, False]


def windows(text, width, overlap):
    """Windows of a text, paragraph by paragraph."""
    text = text.strip()
    if len(text) <= width:
        return [text]
    pieces = []
    for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", text))):
        while len(p) > width:
            blanks = [k for k in range(width // 2 + 1, width) if p[k] == " "]
            at = blanks[-1] if blanks else width
            pieces.append(p[:at].strip())
            p = p[at:].strip()
        pieces += [p] if p else []
    out, now, used = [], "", 0
    for p in pieces:
        if now and used + len(p) + 2 > width:
            out.append(now)
            now = now[-overlap:] if overlap else ""
            used = len(now)
        now = f"{now}\n\n{p}" if now else p
        used += len(p) + 2
    return [*out, now]


@pytest.mark.parametrize(("width", "overlap"), [(40, 10), (25, 0), (100, 30)])
def test_windows_by_brute_force(spark, width, overlap):
    rng = np.random.default_rng(1)
    texts = ["", "  short ", "x" * 130, "x" * 30 + " " + "y" * 200]
    for _ in range(60):
        texts.append("\n\n".join(" ".join("w" * int(n) for n in rng.integers(1, 12, rng.integers(1, 14))) for _ in range(rng.integers(1, 9))))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.windows for r in X.window_text(df, "t", width, overlap).collect()}
    assert got == {k: windows(t, width, overlap) for k, t in enumerate(texts)}


def test_ocr_ratio_by_brute_force(spark):
    fp = spark.createDataFrame([(1, "receipt of a taxi ride"), (2, "receipt of  a TAXI ride"), (3, "receipt for a bus ride"), (4, "short"), (5, None)], "item_id long, ocr_text string")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 1), (5, 1)], "item_id long, other_id long")
    got = {r.item_id: r.ocr for r in receipts.ocr_signal(fp, pairs).collect()}
    assert got == {2: 1.0, 3: pytest.approx(SequenceMatcher(None, "receipt for a bus ride", "receipt of a taxi ride", autojunk=False).ratio()), 4: None, 5: None}


def test_neighbours_within_a_scope(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k % 3, ["a", None][k % 2], rng.standard_normal(8).tolist()) for k in range(200)]
    e = spark.createDataFrame(rows, "vec_id long, tenant int, spec string, embedding array<double>")
    q = e.filter("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    unit = np.array([r[3] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = V.knn(q, e, 4, within=("tenant",), where=F.col("vec_id") % 5 != 0, least=0.0, offset=2).collect()
    for query in range(9):
        s = sorted((-round(float(unit[query] @ unit[k]), 9), k) for k in range(200) if k % 3 == query % 3 and k % 5)
        want = [(k, i + 1) for i, (x, k) in enumerate(s[2:6]) if -x >= 0]
        assert sorted((r.vec_id, r["rank"]) for r in got if r.query_id == query) == sorted(want)
    for bad in ({"k": 0}, {"k": 501}, {"offset": -1}, {"offset": 10_001}):
        with pytest.raises(ValueError):
            V.knn(q, e, **({"k": 3} | bad))


def test_unequal_widths_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="unequal width"):
        df.select(V.dot(F.col("a"), F.col("b"))).collect()
    assert df.select(V.euclidean(F.col("a"), F.col("a")).alias("d"), V.cosine_distance(F.col("a"), F.col("a")).alias("c")).first() == (0.0, pytest.approx(0.0))


def test_vendors_take_known_profiles_first(spark):
    names = [(1, "Uber Trip", 5), (1, " uber  TRIPS", 6), (1, "Hotel Ibis", 1), (1, "hotel ibis paris", 2), (1, "Hotel Ibis", 9), (2, "Uber Trip", 1), (1, "zz", 3)]
    df = spark.createDataFrame(names, "tenant int, merchant_vendor string, seen int")
    aliases = spark.createDataFrame([(1, "uber trip", "U1")], "tenant int, alias string, profile string")
    got = {(r.tenant, r.vendor): (r.profile, r.how) for r in vendors.resolve_vendors(df, aliases).collect()}
    assert got == {
        (1, "uber trip"): ("U1", "EXACT"), (1, "uber trips"): ("U1", "SIMILAR"), (1, "hotel ibis"): ("hotel ibis", "NEW"), (1, "hotel ibis paris"): ("hotel ibis", "SIMILAR"),
        (2, "uber trip"): ("uber trip", "NEW"), (1, "zz"): ("zz", "NEW"),
    }
    assert vendors.resolve_vendors(df.limit(0)).isEmpty()


def test_word_similarity_is_that_of_the_best_stretch():
    grams = lambda t: [f"  {w} "[k : k + 3] for w in t.split() for k in range(len(w) + 1)]
    assert vendors.best_extent(grams("word"), grams("two words")) == pytest.approx(0.8)
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("ab "), 8)) for _ in range(2))
        x, run = set(grams(a)), grams(b)
        brute = max((len(x & set(run[i:j])) / len(x | set(run[i:j])) for i in range(len(run)) for j in range(i + 1, len(run) + 1)), default=0.0)
        assert vendors.best_extent(grams(a), run) == pytest.approx(brute)


def test_scan_uses_every_signal_it_has(spark):
    rows = [
        # item, claim, employee, vendor, profile, day, amount, number, checksum, hash, text, vector
        (1, 1, 1, "uber", "u", "2026-01-05", "10.00", "A", "c1", "ffffffffffffffff", "a taxi ride to town", [1.0, 0.0]),
        (2, 2, 1, "uber trip", "u", "2026-01-05", "99.00", None, "c2", "0000000000000000", "something else", [0.0, 1.0]),
        (3, 3, 2, "uber", "u", "2026-01-05", "10.01", "B", "c3", "fffffffffffffffe", "a taxi ride to town", [1.0, 0.1]),
        (4, 4, 1, "uber", "u", "2026-01-06", "109.00", "C", "c1", None, None, None),
        (5, 5, 3, "solo", "s", "2026-01-06", "1.00", None, None, None, None, None),
    ]
    schema = "item_id long, claim_id long, employee_id long, vendor string, profile string, expense_date string, amount_usd string, invoice_number string, checksum string, image_hash string, ocr_text string, embedding array<double>"
    fp = spark.createDataFrame(rows, schema).withColumns({"expense_date": F.col("expense_date").cast("date"), "amount_usd": F.col("amount_usd").cast("decimal(14,2)")})
    got = {r.item_id: r for r in receipts.scan_duplicates(fp).collect()}
    assert set(got) == {2, 3, 4}
    assert (got[2].alias, got[2].exact, got[2].flags, got[2].verdict) == (1.0, 0.0, "ALIAS", "CONFIRMED")
    assert got[3].flags == "IMAGE,OCR,EMBEDDING,ALIAS,CROSS_EMPLOYEE" and got[3].related == [1] and got[3].near == 1.0
    assert got[4].flags == "EXACT,ALIAS,MULTI_RECEIPT" and sorted(got[4].related) == [1, 2] and got[4].near is None and got[4].hash is None
    bare = receipts.scan_duplicates(fp.drop("profile", "image_hash", "ocr_text", "embedding")).collect()
    assert {r.item_id: r.flags for r in bare}[3] == "CROSS_EMPLOYEE"


def test_tenants_do_not_meet(spark):
    rows = [(1, 1, 1, "v", 1), (2, 2, 2, "v", 2), (3, 3, 3, "v", 1)]
    fp = spark.createDataFrame(rows, "item_id long, claim_id long, employee_id long, vendor string, tenant int")
    fp = fp.withColumns({"expense_date": F.lit("2026-01-01").cast("date"), "amount_usd": F.lit(5).cast("decimal(14,2)"), "status": F.lit("Submitted")})
    assert [tuple(r) for r in U.candidate_pairs(fp).collect()] == [(3, 1)]
    assert sorted(tuple(r) for r in U.cross_employee(fp).collect()) == [(1, 3, 1), (3, 1, 1)]
    assert U.vendor_stats(fp.withColumnRenamed("vendor", "merchant_vendor")).count() == 2


def test_partners_by_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(k, int(rng.integers(3)), int(rng.integers(4)), int(rng.integers(6))) for k in range(120)]
    df = spark.createDataFrame(rows, "item_id long, k int, own int, cents long")
    for near, apart in ((None, 0), ("cents", 1)):
        keys = ["k", "cents"] if near is None else ["k"]
        got = {r.item_id: (r.first_id, r.links) for r in U.partners(df, keys, "own", near).collect()}
        want = {}
        for i, k, own, c in rows:
            met = [j for j, k2, own2, c2 in rows if k2 == k and own2 != own and abs(c2 - c) <= apart]
            if met:
                want[i] = (min(met), len(met))
        assert got == want


def test_languages(spark):
    texts = ["これは日本語の文章です、ありがとう", "这是一个中文句子没有假名在里面", "это русский текст для проверки", "the policy of the employee is in", "la de que en", "12345 67890 12345", "short", None, "हिन्दी में लिखा हुआ वाक्य है"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = [r.language for r in T.with_language(df).orderBy("k").collect()]
    assert got == ["ja", "zh", "ru", "en", "es", None, None, None, "hi"] or got[:4] + got[5:] == ["ja", "zh", "ru", "en", None, None, None, "hi"]


def test_routes_and_versions(spark):
    items = spark.createDataFrame(
        [(1, False, 0, True, False, True, False, False), (2, False, 0, True, False, False, False, False), (3, False, 0, True, False, None, True, False), (4, False, 0, True, False, True, False, True), (5, True, 50, False, False, False, True, True)],
        "item_id int, is_flagged boolean, risk_score int, policy_passed boolean, manual_review boolean, travel_passed boolean, travel_review boolean, category_review boolean",
    )
    got = {r.item_id: r.route for r in lifecycle.route_items(items).collect()}
    assert got == {1: "Auto_Approved", 2: "Policy_Hold", 3: "Policy_Hold", 4: "Policy_Hold", 5: "Fraud_Flag"}
    docs = spark.createDataFrame([(5, "en", "a"), (6, "en", "b"), (7, "en", "a")], "doc_id long, lang string, text string")
    stored = D.dedup_documents(docs.filter("doc_id = 6")).select("lang", "checksum", F.lit(1).cast("long").alias("doc_id"))
    assert {r.doc_id: (r.first_id, r.status) for r in D.dedup_documents(docs, existing=stored).collect()} == {5: (5, "INDEXED"), 6: (1, "SKIPPED_DUPLICATE"), 7: (5, "SKIPPED_DUPLICATE")}
    batch = spark.createDataFrame([("t", 1, "s"), ("t", 1, "s"), ("t", 2, "r")], "tenant string, chunk_id long, spec string")
    assert {r.fault: r.n for r in D.check_batch(batch).collect()} == {"REPEATED_KEY": 1, "SEVERAL_SPECS": 1}


def test_source_types(spark):
    df = spark.createDataFrame([(1, "Invoice number 7, amount due, bill to us"), (2, "word " * 3000 + "invoice date"), (3, None), (4, ""), (5, "faq policy")], "doc_id long, text string")
    got = {r.doc_id: r.source_type for r in knowledge.classify_source_type(df).collect()}
    assert got == {1: "INVOICE", 2: "OTHER", 3: "OTHER", 4: "OTHER", 5: "FAQ"}


def test_extractor_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "no json"), (3, "{}"), (4, '{"ExpenseDocuments": [{}, {"SummaryFields": [{"Type": {"Text": "TOTAL"}, "ValueDetection": {"Text": "SGD 12"}}, {"Type": null}]}]}')], "k int, json string")
    got = {r.k: r for r in X.parse_expense_response(df, "json").collect()}
    assert [got[k].line_items for k in (1, 2, 3, 4)] == [[], [], [], []] and got[1].fields == [] and got[1].summary.vendor_name is None
    assert (got[4].summary.total_amount, got[4].summary.currency, len(got[4].fields)) == (12.0, "SGD", 2)
    empty = X.summarize_extraction(df, "json").collect()
    assert all(r.vendor is None and r.confidences == [] for r in empty)
    assert [r.rules for r in X.parse_rules(df, "json").orderBy("k").collect()][:3] == [[], [], []]


def test_every_id_of_the_inventory_has_a_query():
    ids = {n[:6] for n in registry.queries()}
    whole = {"src": 10, "txt": 17, "doc": 11, "chk": 9, "emb": 11, "ret": 15, "ven": 3, "dup": 16, "pol": 20, "sub": 9, "frd": 10, "lif": 17, "aud": 6, "str": 5}
    # Named in another query's docstring.
    covered = {"src_06", "txt_05", "doc_05", "emb_04", "emb_09", "ret_07", "ret_08", "ret_09", "ret_10", "ven_01", "dup_02", "dup_07", "dup_08", "dup_11"}
    covered |= {"pol_09", "pol_10", "pol_11", "pol_13", "frd_01", "frd_02", "frd_03", "frd_04", "frd_05", "frd_06"}
    missing = {f"{kind}_{k:02}" for kind, n in whole.items() for k in range(1, n + 1)} - ids - covered
    assert not missing


def test_numbers_of_groups_of_any_size(spark):
    from quillet.operators.blocks import numbered

    rng = np.random.default_rng(5)
    rows = [(k, None if rng.random() < 0.1 else "hot" if rng.random() < 0.7 else f"g{rng.integers(5)}", int(rng.integers(50))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, g string, v int").repartition(6)
    got = {r.doc_id: (r._place, r._total, r._before, r._after) for r in numbered(df, ["g"], ["v", "doc_id"], "doc_id").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        ids = [k for _, k in sorted((v, k) for k, h, v in rows if h == g)]
        want |= {k: (i + 1, len(ids), ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None) for i, k in enumerate(ids)}
    assert got == want


def test_claim_search_covers_all_reviewers(spark):
    """The registered search is not narrowed to one reviewer's claims."""
    from quillet.plans import claims as plans

    found = plans.lif_10_search(spark, "/root/testdata/sf0.001").select("claim_id")
    reviewers = {r[0] for r in plans._claims(spark, "/root/testdata/sf0.001").join(found, "claim_id", "left_semi").select("reviewer_id").distinct().collect()}
    assert len(reviewers) > 1 and "reviewer_id = 3" not in registry.oracle_sql()["lif_10_search"]


def test_vendor_names_meet_on_two_rare_grams(spark):
    """No similar pair is lost, and names of the same few digits are not all listed as pairs."""
    names = [f"shop {k}" for k in range(10000, 40000, 97)]
    df = spark.createDataFrame([(1, n) for n in names], "tenant int, known string")
    met = {(r.known, r.name) for r in vendors.names_to_score(df, df.withColumnRenamed("known", "name"), 0.8).collect()}
    grams = {n: [f"  {w} "[k : k + 3] for w in n.split() for k in range(len(w) + 1)] for n in names}
    enough = {(a, b) for a in names for b in names if len(set(grams[a]) & set(grams[b])) >= math.ceil(len(set(grams[a])) * 0.8)}
    assert met == enough and len(met) < 10 * len(names)
