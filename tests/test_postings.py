"""The written index of chunks against brute force, and its plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators import postings as P
from quillet.operators import retrieval as R

FOLDER = "/root/testdata/sf0.001"


def texts():
    rng = np.random.default_rng(2)
    words = ["taxi", "Hotel", "the", "Über", "naïve", "x", "receipt42", "of", "a_b", "meal", "漢字", "ﬁ"]
    out = [None, "", " ... ", "the", "the the the", "THE TAXI", "x " * 500]
    return out + [" ".join(rng.choice(words, int(rng.integers(1, 14)))) + rng.choice(["", ".", "!?", " -"]) for _ in range(250)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    chunks = spark.createDataFrame(list(enumerate(texts())), "vec_id long, text string").repartition(3)
    return P.build(chunks, f"file://{tmp_path_factory.mktemp('postings')}/i", 4)


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["taxi", "the taxi", "hotel naïve the", "nothing at all", "", None, "über x", "THE of the meal receipt42 taxi hotel", "漢字", "a b", "taxis and hotels"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")


def brute_lexical(query, n=50):
    asked, found = set(R.terms(query)), []
    for k, t in enumerate(texts()):
        own = R.terms(t)
        if asked and asked <= set(own):
            found.append((-round(R.cover_density({w: [i for i, x in enumerate(own) if x == w] for w in asked}), 9), k))
    return [(k, -s) for s, k in sorted(found)[:n]]


def brute_similar(query, least, n=50):
    asked, found = R.trigrams(query), []
    for k, t in enumerate(texts()):
        own = R.trigrams(t)
        share = len(asked & own) / max(1, len(asked | own))
        if share > least:
            found.append((-round(share, 9), k))
    return [(k, -s) for s, k in sorted(found)[:n]]


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("n", [50, 3])
def test_lexical_by_brute_force(queries, index, n):
    want = {r.query_id: brute_lexical(r.query, n) for r in queries.collect()}
    assert by_query(R.lexical_search(queries, index, n)) == {q: v for q, v in want.items() if v}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.9])
def test_similar_by_brute_force(queries, index, least):
    want = {r.query_id: brute_similar(r.query, least) for r in queries.collect()}
    assert by_query(R.trigram_search(queries, index, least=least)) == {q: v for q, v in want.items() if v}


def test_within(spark, queries, index):
    within = spark.range(0, 300, 2).withColumnRenamed("id", "vec_id")
    got = by_query(R.lexical_search(queries, index, 300, within))
    want = {r.query_id: [x for x in brute_lexical(r.query, 300) if x[0] % 2 == 0] for r in queries.collect()}
    assert got == {q: v for q, v in want.items() if v}
    with pytest.raises(ValueError):
        P.similar(queries, index, least=0.1)


def test_postings_join_where_they_lie(spark, queries, index):
    """The postings are not shuffled, and nothing but the matched rows reaches Python."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.lexical(queries, index, P.per_row(R._density))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(x for x in plan.split("\n") if "FileScan" in x and "_words" in x)
    above = plan.split("\n")[: plan.split("\n").index(scan)]
    assert "Bucketed: true" in scan and "ArrowEvalPython" in plan
    assert "Exchange" not in "".join(above[-4:]) and plan.count("ArrowEvalPython") == 1


def test_another_session_reads_the_index(spark, queries, index):
    want = by_query(R.trigram_search(queries, index))
    for name in P._TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {P._name(index, name)}")  # as if the session had not written it; its files stay
    assert by_query(R.trigram_search(queries, index)) == want


def test_hot_word_is_spread(spark, tmp_path):
    """The chunks of a word that all of them hold are written by many tasks."""
    chunks = spark.range(20_000).select(F.col("id").alias("vec_id"), F.concat(F.lit("common w"), F.col("id")).alias("text")).repartition(8)
    index = P.build(chunks, f"file://{tmp_path}/hot", 4)
    assert P.table(spark, index, "words").filter("term = 'common'").count() == 20_000
    asked = spark.createDataFrame([(1, "common w77"), (2, "common")], "query_id long, query string")
    got = by_query(R.lexical_search(asked, index, 5))
    assert [v for v, _ in got[1]] == [77] and [v for v, _ in got[2]] == [0, 1, 2, 3, 4]


def test_empty(spark, queries, tmp_path):
    index = P.build(spark.createDataFrame([], "vec_id long, text string"), f"file://{tmp_path}/none", 4)
    assert R.lexical_search(queries, index).isEmpty() and R.trigram_search(queries, index).isEmpty()


def test_trigrams_are_not_shuffled(spark, queries, index):
    """A 3-gram search reads the chunks where they lie: no 3-gram is a row, and blocks of queries give what one gives."""
    found = P.similar(queries, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan
    want = by_query(found)
    P.MAX_ASKED, kept = 3, P.MAX_ASKED
    try:
        assert by_query(P.similar(queries, index)) == want
    finally:
        P.MAX_ASKED = kept
