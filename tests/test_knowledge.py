"""Small cases of parsing, personal data, chunking and retrieval, and brute-force versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.functions import folding
from quillet.operators import chunking, parsing, pii
from quillet.operators import claims as C
from quillet.operators import retrieval as R
from quillet.operators import travel
from quillet.operators import vectors as V

TEXT = "One two three. Four five six seven! Eight?\n\nNine ten, Mr. Eleven pays 1.50 now. Twelve."


def test_normal_and_folded(spark):
    text = "reim-\nburse\u00ad  \ufb01x \u201ca\u201d\r\n\n\n\n b "
    made = spark.createDataFrame([(text,), (None,), ("a\x00\tb\rc   d",), (" \n\n\n",)], "t string").select(folding.normalize_text("t").alias("t")).collect()
    assert [r.t for r in made] == ['reimburse fix "a"\n\nb', "", "a b\nc d", ""]
    assert folding.fold("\u00c9COLE *Stra\u00dfe*") == "ecole strasse"


def test_sentences_agree(spark):
    want = ["One two three.", "Four five six seven!", "Eight?", "Nine ten, Mr. Eleven pays 1.50 now.", "Twelve."]
    assert folding.sentences(TEXT) == want
    assert spark.range(1).select(folding.split_sentences(F.lit(TEXT)).alias("s")).first().s == want


def test_cut_keeps_a_boundary(spark):
    texts = ["aaaa bbbb cccc dddd eeee", "short", None, "", "aaaa bbb. cc dddddddd", "aaaa bbbbb\nc ddddddddd", "a" * 40, "\u65e5" * 20]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    cut = lambda n: [r.t for r in df.select("k", folding.truncate_to_tokens(F.col("t"), n).alias("t")).orderBy("k").collect()]
    assert cut(4) == ["aaaa bbbb cccc", "short", None, "", "aaaa bbb. cc", "aaaa bbbbb", "a" * 16, "\u65e5" * 4]
    assert cut(0) == ["", "", None, "", "", "", "", ""]


def test_html_sections(spark):
    page = "<p>lead<script>var x='<h1>no</h1>'</script></p><h1>A &amp; B</h1>one<h3>C</h3><b>two</b> three<h2>D</h2>"
    rows = parsing.parse_html(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("section").collect()
    assert [(r.level, r.path, r.text) for r in rows] == [(0, [], "lead"), (1, ["A & B"], "one"), (3, ["A & B", "C"], "two three"), (2, ["A & B", "D"], "")]


def test_markdown_json_csv_and_bytes(spark, tmp_path):
    md = parsing.markdown_sections("x\n# A\n```\n# no\n```\n## B ##\ny")
    assert [(s["heading"], s["path"], s["text"]) for s in md] == [("", [], "x"), ("A", ["A"], "```\n# no\n```"), ("B", ["A", "B"], "y")]
    assert parsing.json_lines('{"a": {"b": [1, null]}, "c": true, "d": {}}') == "a.b[0]: 1\na.b[1]: null\nc: true\nd: {}"
    assert parsing.json_lines("{") is None and parsing.csv_lines('a,"b,c"\n , \nd,e') == "a\tb,c\nd\te"
    (tmp_path / "t.html").write_bytes("é€".encode("cp1252"))
    row = parsing.read_documents(spark, f"{tmp_path}/*").withColumn("text", parsing.decode_text("content")).first()
    assert (row.name, row.mime_type, row["size"], row.text) == ("t.html", "text/html", 2, "é€")


def test_pii(spark):
    text = "Mail a.b@c.org, card 4111 1111 1111 1111 not 4111 1111 1111 1112; GB82WEST12345698765432. passport X1234567. Dr. Jane Doe, SSN 123-45-6789, account 12345678901"
    found = {(f["kind"], text[f["start"] : f["end"]]) for f in pii.findings(text)}
    want = {("EMAIL", "a.b@c.org"), ("CREDIT_CARD", "4111 1111 1111 1111"), ("IBAN", "GB82WEST12345698765432"), ("PASSPORT", "X1234567"), ("PERSON_NAME", "Jane Doe"), ("NATIONAL_ID", "123-45-6789"), ("BANK_ACCOUNT", "12345678901")}
    assert want <= found and ("CREDIT_CARD", "4111 1111 1111 1112") not in found
    spans = sorted((f["start"], f["end"]) for f in pii.findings(text))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert pii.findings(None) == [] and pii.masked("ab") == "**" and pii.masked("abc") == "a*c"
    df = spark.createDataFrame([(1, "a.b@c.org x"), (2, "4111111111111111"), (3, None)], "doc_id long, text string")
    kept, refused = pii.apply_pii_policy(df, "MASK", ("CREDIT_CARD",))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "[REDACTED:EMAIL] x", 3: None} and [r.doc_id for r in refused.collect()] == [2]
    assert {r.kind: r.documents for r in pii.pii_summary(pii.scan_pii(df)).collect()} == {"EMAIL": 1, "CREDIT_CARD": 1}


@pytest.mark.parametrize("strategy", chunking.STRATEGIES)
def test_chunks_fit_and_cover(spark, strategy):
    small = chunking.Budget(most=12, overlap=3, least=3, parent=40, stride=6)
    docs = spark.createDataFrame([(1, "# H\n" + TEXT * 3), (2, ""), (3, None), (4, "word " * 400)], "doc_id long, text string")
    rows = chunking.chunk(docs, strategy, small).collect()
    children = [r for r in rows if strategy != "PARENT_CHILD" or r.parent_id]
    assert {r.doc_id for r in rows} == {1, 4} and all(r.tokens <= 12 for r in children)
    words = {w for r in children for w in (r.text + " " + r.section).split()}
    assert set(TEXT.split()) - words <= {"#"} and len({r.chunk_id for r in rows}) == len(rows)
    assert chunking.check_chunks(spark.createDataFrame(rows, chunking.chunk(docs, strategy, small).schema), small).count() == 0


def test_overlap_and_violations(spark):
    words = [f"w{k:02}x" for k in range(40)]
    parts = chunking.packed(words, 10, 3)
    assert all(a.split()[-2:] == b.split()[:2] for a, b in zip(parts, parts[1:], strict=False))
    bad = spark.createDataFrame([("a", "gone", 5), ("b", None, 999)], "chunk_id string, parent_id string, tokens int")
    assert {r.chunk_id: r.violation for r in chunking.check_chunks(bad).collect()} == {"a": "DANGLING_PARENT", "b": "OVER_BUDGET"}


def test_hashed_vectors():
    v = chunking.hashed("Uber trip")
    assert math.isclose(np.linalg.norm(v), 1) and np.allclose(v, chunking.hashed("UBER *TRIP")) and not chunking.hashed("").any()


def brute_density(places):
    """Every window that is minimal: holds all terms, and neither end can move in."""
    entries = sorted((p, t) for t, ps in places.items() for p in ps)
    need, total = set(places), 0.0
    for a in range(len(entries)):
        for b in range(a, len(entries)):
            held = [t for _, t in entries[a : b + 1]]
            if set(held) == need and set(held[1:]) != need and set(held[:-1]) != need:
                total += 0.1 / (1 + entries[b][0] - entries[a][0] - (b - a))
    return total


def test_cover_density():
    rng = np.random.default_rng(3)
    for _ in range(200):
        taken = rng.permutation(30)
        places = {t: sorted(map(int, taken[k * 4 : k * 4 + rng.integers(1, 5)])) for k, t in enumerate("abc")}
        assert math.isclose(R.cover_density(places), brute_density(places))


def test_lexical_leg_and_fallback(spark):
    queries = spark.createDataFrame([(1, "meal limit"), (2, "lodgings capp"), (3, None)], "query_id long, query string")
    chunks = spark.createDataFrame([(10, "the meal limit is low"), (11, "limit of a meal"), (12, "meal only"), (13, "lodging cap"), (14, None)], "vec_id long, text string")
    assert [(r.query_id, r.vec_id) for r in R.lexical_search(queries, chunks).orderBy("query_id", "rank").collect()] == [(1, 10), (1, 11)]
    assert [(r.query_id, r.vec_id) for r in R.lexical_leg(queries, chunks).orderBy("query_id", "rank").collect()] == [(1, 10), (1, 11), (2, 13)]


def test_scope_rerank_citations(spark):
    docs = spark.createDataFrame([(1, "A", 2, "INDEXED", None, "2026-01-01"), (2, "B", 1, "SUPERSEDED", None, None)], "doc_id long, title string, version int, status string, effective_from string, effective_to string")
    ranked = spark.createDataFrame([(7, 1, 1, "s", 3, 1, "Meal LIMIT here", "meal limit"), (7, 2, 1, "s", 4, 2, "meal", "meal limit"), (7, 3, 2, "", None, 3, "x", "meal limit")], "query_id long, vec_id long, doc_id long, section string, page int, final_rank int, text string, query string")
    assert {r.vec_id for r in R.document_scope(ranked, docs, F.lit("2025-06-01")).collect()} == {1, 2} and R.document_scope(ranked, docs, F.lit("2026-06-01")).count() == 0
    assert {r.vec_id: round(r.rerank_score, 3) for r in R.rerank(ranked).collect()} == {1: 1.0, 2: 0.35, 3: 0.0}
    assert [(r.citation, r.label) for r in R.attach_citations(ranked, docs).orderBy("citation").collect()] == [(1, "A, v2, s, p. 3"), (2, "B, v1")]
    one = R.build_context(ranked, 4).first()
    assert (one.chunks, one.truncated, one.context) == (1, True, "[1] Meal LIMIT here")


def test_compress_keeps_the_best(spark):
    text = "Nothing here at all to see. " * 20 + "The meal limit is forty. " + "More of the same text again. " * 20
    out = spark.createDataFrame([("meal limit", text)], "q string, t string").select(R.compress(F.col("q"), F.col("t"), 320, 10).alias("c")).first().c
    assert "The meal limit is forty." in out and chunking.count(out) <= 32


def test_travel_catch_all_yields(spark):
    items = spark.createDataFrame([(1, "Hotel / Lodging", "Local", "Band 1", "Day", 10.0, "INR"), (2, "Meals", "Local", "Band 1", "Day", 350.0, "INR"), (3, None, None, None, None, 500.0, "INR")], "item_id long, category string, travel_type string, grade_band string, duration string, amount double, currency string")
    out = {r.item_id: (r.passed, r.eligible, r.checks) for r in travel.evaluate_travel_policy(items, travel.seed_travel_rules(spark)).collect()}
    assert out == {1: (False, 0.0, "LOCAL_HOTEL_PROHIBITED-"), 2: (False, 300.0, "LOCAL_MEAL_1-"), 3: (False, 400.0, "UNSCOPED_CAP-")}


def test_pages_are_bounded(spark):
    logs = spark.createDataFrame([(k, 1, k) for k in range(5)], "event_id long, entity_id long, occurred_at long")
    assert [r.event_id for r in C.search_audit(logs, offset=1, limit=2).collect()] == [3, 2]
    with pytest.raises(ValueError):
        C.search_audit(logs, limit=501)


def test_queries_in_blocks(spark, monkeypatch):
    """Seven queries, two vectors at a time, give the rows of one pass; so do the legs joined afterwards."""
    texts = ["red taxi to the station", "hotel near the station", "late dinner with a client", "taxi receipt lost", "dinner receipt", "red hotel", "client taxi"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    chunks = spark.createDataFrame([(k, f"{a} and {b}") for k, (a, b) in enumerate((a, b) for a in texts for b in texts)], "vec_id long, text string").repartition(3)
    vectors = R.embed_hash(chunks).select("vec_id", "embedding")
    asked = R.embed_hash(queries.select("query_id", F.col("query").alias("text"))).select("query_id", "embedding")

    def run():
        legs = {"lexical": R.lexical_leg(queries, chunks, 4), "trigram": R.trigram_search(queries, chunks, 4), "dense": V.knn(asked, vectors, 4)}
        fused = V.rrf({k: v.select("query_id", "vec_id", "rank") for k, v in legs.items()}, {"lexical": 0.4, "trigram": 0.2, "dense": 0.4})
        return [sorted(map(tuple, x.collect())) for x in (*legs.values(), fused.withColumn("fused", F.round("fused", 9)), V.min_max(legs["dense"]))]

    whole = run()
    monkeypatch.setattr(V, "MAX_QUERIES", 2)
    assert run() == whole and {r[0] for r in whole[2]} == set(range(7))


def test_whole_texts_are_read(spark):
    """Whole benchmark texts against brute force, CSV rows after 5,000, and stop words after 4,000 characters."""
    from quillet.functions import text as T
    from quillet.plans import knowledge as K

    folder = "/root/testdata/sf0.001"
    queries = {r.item_id: r.text for r in K.tables.load(spark, folder, "benchmark").collect()}
    lines = [(r.vec_id, R.trigrams(r.text)) for r in K._paragraphs(spark, folder).collect()]
    want = set()
    for q, text in queries.items():
        g = R.trigrams(text)
        want |= {(q, v) for _, v in sorted((-round(len(g & x) / len(g | x), 9), v) for v, x in lines if len(g & x) / max(len(g | x), 1) > R.SIMILAR)[:50]}
    lexical = {r.query_id for r in K.ret_01_lexical(spark, folder).collect()}
    got = {(r.query_id, r.vec_id) for r in K.ret_03_leg(spark, folder).collect() if r.query_id not in lexical}
    assert got == {x for x in want if x[0] not in lexical} and got
    assert parsing.csv_lines("a,b\n" * 6000).count("a\tb") == 6000
    long = spark.createDataFrame([("zzz " * 2000 + "the and of the and",)], "t string").select(*T.stop_word_counts(T.stop_words_in(F.col("t"))))
    assert sum(long.first().asDict().values()) > 0


def test_chunks_leave_a_task_in_small_batches(spark):
    """Chunks are handed on row by row, not as one list a text in a whole batch, and parents keep their names."""
    docs = spark.createDataFrame([(1, "a b. " * 30), (None, "c d. " * 30), (3, None)], "doc_id long, text string")
    out = chunking.chunk(docs, "PARENT_CHILD", chunking.Budget(most=12, overlap=3, least=3, parent=40, stride=6))
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    rows = out.collect()
    ids = {r.chunk_id for r in rows}
    assert {r.doc_id for r in rows} == {1, None} and all(r.parent_id is None or r.parent_id in ids for r in rows) and any(r.parent_id for r in rows)


def test_truncation_counts_a_text_once(spark):
    """The size of the head is bound once, however often it is used: a text meets the script count twice, for its share and its tokens."""
    from quillet.functions.folding import truncate_to_tokens

    docs = spark.createDataFrame([("word. " * 200,), ("漢字 text. " * 90,), ("short",), ("",), (None,)], "text string")
    out = docs.select(truncate_to_tokens(F.col("text"), 20).alias("t"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 6
    rows = [r.t for r in out.collect()]
    assert rows[0] == ("word. " * 13).strip() and rows[2:] == ["short", "", None] and rows[1].endswith(".")


def test_hashed_texts_are_those_of_one_text_each():
    """Texts hashed together, over the bound of a run and with more different characters than a run has numbers for."""
    many = ["".join(map(chr, range(0x4E00, 0x9E00))) + "".join(map(chr, range(0x20000, 0x2A000))), "".join(map(chr, range(0xAC00, 0xD7A0)))]
    texts = ["Uber trip", "", None, "a", "  ", "\u6f22\u5b57 \U0001f600 x", "Stra\u00dfe", *many, *(f"line {k} " * (k % 40) for k in range(500))]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chunking, "_HASHED_CHARS", 50_000)
        got = list(chunking.hashed_all(texts))
    assert len(got) == len(texts) and all(np.array_equal(a, chunking.hashed(t)) for a, t in zip(got, texts, strict=True))
    assert list(chunking.hashed_all([])) == []
