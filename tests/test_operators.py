"""Cases of single operators."""

import pandas as pd
from pyspark.sql import functions as F

from quillet.functions import text as T
from quillet.operators import documents as D
from quillet.operators import claims, fraud, lifecycle, policy
from quillet.operators import vectors as V
from quillet.streaming import jobs


def test_publish_and_replace(spark):
    rules = policy.seed_rules(spark)
    batch = rules.filter("code = 'MEALS_STANDARD'").withColumn("max_amount", F.lit(60.0))
    out = {(r.code, r.version): r for r in policy.publish_rules(rules, batch, "2026-02-01").collect()}
    assert not out["MEALS_STANDARD", 1].is_active and str(out["MEALS_STANDARD", 1].effective_to) == "2026-02-01"
    assert out["MEALS_STANDARD", 2].is_active and out["MEALS_STANDARD", 2].max_amount == 60
    replaced = policy.replace_ruleset(rules, batch, "2026-02-01")
    assert [(r.code, r.version) for r in replaced.filter("is_active").collect()] == [("MEALS_STANDARD", 2)]
    assert policy.latest_versions(replaced).count() == 6
    assert policy.effective_rules(rules, "2026-01-01").first().code == "CLAIM_AGE_LIMIT"


def test_sequence_gap_is_found(spark):
    rows = [(1, 7, 1, None, "Submitted"), (2, 7, 3, "Submitted", "Processing")]
    history = spark.createDataFrame(rows, "event_id long, claim_id long, sequence int, from_status string, to_status string")
    assert [r.event_id for r in lifecycle.check_sequence(history).collect()] == [2]


def test_latest_fraud_and_manual_flag(spark):
    rows = [(1, 5, "2026-01-01", "2026-01-01", 1, ["A"]), (1, 30, "2026-01-02", "2026-01-02", 2, ["B"])]
    latest = fraud.latest_fraud(spark.createDataFrame(rows, "claim_id long, risk_score int, evaluated_at string, created_at string, id long, flags array<string>"))
    assert latest.first().risk_score == 30
    out = fraud.apply_manual_flags(latest, spark.createDataFrame([(1,), (2,)], "claim_id long")).orderBy("claim_id").collect()
    assert [(r.risk_score, r.flags) for r in out] == [(40, ["B", "MANUAL_FLAG"]), (40, ["MANUAL_FLAG"])]


def test_text_functions(spark):
    df = spark.createDataFrame([("One.\n\nTwo\n12\nPage 3",), ("",), (None,)], "t string")
    rows = df.select(T.split_paragraphs(F.col("t")).alias("p"), T.estimate_tokens(F.col("t")).alias("n"), T.strip_page_numbers(F.col("t")).alias("s")).collect()
    assert rows[0].p == ["One.", "Two\n12\nPage 3"] and rows[0].s == "One.\n\nTwo" and rows[1].n == 0 and rows[2].n == 0
    lang = spark.createDataFrame([("the policy and the employee",), ("der die das und nicht",), ("xyz",)], "t string").select(*T.stop_word_counts(T.stop_words_in(F.col("t"))))
    assert [r[0] for r in lang.select(T.detect_latin_language()).collect()] == ["en", "de", None]
    assert df.select(T.snippet(F.lit("a " * 300), 10).alias("x")).first().x == "a a a a a…"


def test_boilerplate_and_upserts(spark):
    sections = spark.createDataFrame([(1, k, f"Header\nbody {k}") for k in range(4)], "doc_id long, section int, text string")
    assert [r.line for r in D.boilerplate_lines(sections).collect()] == ["header"]
    old = spark.createDataFrame([("t", 1, "s", 1.0), ("t", 2, "s", 2.0)], "tenant string, chunk_id long, spec string, v double")
    new = spark.createDataFrame([("t", 2, "s", 9.0), ("t", 3, "s", 3.0)], old.schema)
    assert {(r.chunk_id, r.v) for r in D.upsert_embeddings(old, new).collect()} == {(1, 1.0), (2, 9.0), (3, 3.0)}
    assert D.chunks_missing_embedding(old, new).count() == 1
    docs = old.withColumn("doc_id", F.col("chunk_id"))
    assert D.delete_by_document(docs, docs.filter("chunk_id = 1")).count() == 1


def test_budget_skips_and_goes_on(spark):
    rows = [(1, 1, 11, 50), (1, 2, 12, 60), (1, 3, 13, 40)]
    out = V.pack_budget(spark.createDataFrame(rows, "query_id long, rank int, vec_id long, tokens long"), 100).first()
    assert (out.used, out.kept, out.truncated) == (90, "11,13", True)


def test_recall(spark):
    exact = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, vec_id long")
    assert V.recall_at_k(exact.filter("vec_id = 1"), exact).first().recall == 0.5


def test_streams(spark, tmp_path):
    spans = pd.DataFrame({"ts": pd.to_datetime(["2026-01-01 00:01", "2026-01-01 00:02", "2026-01-01 00:07"]), "operation": ["a"] * 3, "duration_ms": [1, 2, 3], "failed": [True, False, False]})
    spark.createDataFrame(spans).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, operation string, duration_ms long, failed boolean").parquet(f"{tmp_path}/in")
    query = jobs.stream_metrics(stream).writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.runs for r in spark.table("metrics").collect()) == [1, 2]


def test_spans_of_any_depth(spark):
    """A chain of 31 spans, a heap of 5,000 and a span under a missing parent."""
    up = {(1, k): k - 1 or None for k in range(1, 32)} | {(2, k): k // 2 or None for k in range(1, 5001)}
    spans = spark.createDataFrame([(t, n, p) for (t, n), p in up.items()] + [(3, 2, 9)], "trace_id long, span_id long, parent_id long")
    got = claims.flatten_spans(spans.repartition(3)).collect()

    def path(t, n):
        return [*(path(t, up[t, n]) if up[t, n] else []), f"{n:012}"]

    assert sorted((r.trace_id, r.span_id, r.depth, r.path) for r in got) == sorted((t, n, len(path(t, n)) - 1, "/".join(path(t, n))) for t, n in up)
    assert claims.flatten_spans(spans.limit(0)).count() == 0
