"""The written index of approximate neighbours: recall, pruning, sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators import neighbours as N
from quillet.operators import vectors as V


@pytest.fixture(scope="module")
def given(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    return e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def index(given, tmp_path_factory):
    return N.build(given[0], f"file://{tmp_path_factory.mktemp('index')}/i")


def test_every_vector_is_indexed_once(spark, given, index):
    model, codes = N.load(spark, index), N.table(spark, index, "codes")
    assert model.size.sum() == codes.count() == N.table(spark, index, "vectors").select("vec_id").distinct().count() == given[0].count()
    assert {r["list"]: r["count"] for r in codes.groupBy("list").count().collect()} == {k: n for k, n in enumerate(model.size) if n}
    assert all(model.part[r["list"]] == r["part"] for r in codes.select("list", "part").distinct().collect())


def test_recall_with_a_quarter_of_the_vectors(spark, given, index):
    vectors, queries = given
    q = np.array([r.embedding for r in queries.orderBy("query_id").collect()])
    model = N.load(spark, index)
    looked = N.probes(model, N._unit(q), N.VISIT)
    assert (looked @ model.size).max() <= 0.25 * model.size.sum() and N.RERANK * 10 <= 0.25 * model.size.sum()
    found = N.search(spark, index, queries)
    assert V.recall_at_k(found, V.knn(queries, vectors, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    exact = {(r.query_id, r.vec_id): r.score for r in V.knn(queries, vectors, 500).collect()}
    assert all(exact[r.query_id, r.vec_id] == pytest.approx(r.score, abs=1e-8) for r in found.collect() if (r.query_id, r.vec_id) in exact)


def test_codes_come_close(spark, given, index):
    """What codes and lists say of a vector is near to the vector."""
    model = N.load(spark, index)
    rows = N.table(spark, index, "codes").join(given[0], "vec_id").select("list", "code", "embedding").collect()
    v = N._unit(np.array([r.embedding for r in rows], float))
    codes = np.stack([np.frombuffer(r.code, np.uint8) for r in rows])
    made = model.centroids[[r.list for r in rows]] + np.concatenate([b[codes[:, j]] for j, b in enumerate(model.books)], 1)[:, : v.shape[1]]
    assert ((made - v) ** 2).sum(1).mean() < 0.5 * ((model.centroids[[r.list for r in rows]] - v) ** 2).sum(1).mean()


def test_only_probed_directories_are_read(spark, given, index):
    model = N.load(spark, index)
    one = np.array([given[1].first().embedding])
    looked = N.probes(model, N._unit(one), 0.02)
    pruned = N.lists_read(N.table(spark, index, "codes"), model, looked)
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "list" in plan.split("PushedFilters: [")[1]
    assert len(pruned.inputFiles()) >= 1 and pruned.count() == model.size[looked[0]].sum()
    read = pruned.select("part").distinct().count()
    assert read < len(set(model.part)) / 2


def test_few_and_equal_vectors(spark, given, tmp_path):
    none = given[0].limit(0)
    assert N.ann(given[1].limit(3), none).isEmpty() and N.ann(given[1].limit(0), given[0].limit(50)).isEmpty()
    rows = [(k, [1.0, 0.0, 0.0, 0.0, 0.0] if k < 400 else [float(k % 7), float(k % 11), float(k % 13), 1.0, 0.5]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    folder = N.build(df, f"file://{tmp_path}/hot")
    found = N.search(spark, folder, df.filter("vec_id in (3, 450)").withColumnRenamed("vec_id", "query_id"), k=5, visit=1.0).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 3 and r.score == 1.0 and r.vec_id < 400]
    best = next(r for r in found if r.query_id == 450 and r.rank == 1)
    assert best.score == 1.0 and rows[best.vec_id][1] == rows[450][1]


def test_what_is_broadcast_does_not_hold_scores_of_lists(spark, tmp_path, monkeypatch):
    """A query travels as its vector and a bit for each list, not as scores of every list and code."""
    import pickle

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    folder = N.build(vectors, f"file://{tmp_path}/i")
    sent = []
    monkeypatch.setattr(N, "PROBED", 64)
    asked = vectors.limit(300).collect()
    found, shared = N._search(spark, folder, asked, 5, 0.25, 100)
    sent = len(pickle.dumps(shared.value[:3]))
    assert sent < 300 * (8 + 16 * 8 + len(shared.value[3]) // 8 + 1) + 2_000
    best = {r.query_id: r.vec_id for r in found.filter("rank = 1").collect()}
    assert len(best) == 300 and all(q == v for q, v in best.items())
