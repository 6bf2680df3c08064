"""Version chains by links, and the keyed table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators import chains
from quillet.sources import keyed


def brute(links):
    out = {}
    for start in links:
        chain, seen = [start], {start}
        while (up := links[chain[-1]]) is not None and up in links and up not in seen:
            chain.append(up)
            seen.add(up)
        out[start] = (len(chain), chain[-1], up is not None and up in links)
    return out


def got(spark, links):
    df = spark.createDataFrame(list(links.items()), "doc_id long, supersedes_id long").repartition(3)
    return {r.doc_id: (r.place, r.oldest, r.cyclic) for r in chains.version_chains(df).collect()}


def test_chain_cycle_missing(spark):
    links = {k: k - 1 for k in range(1, 41)} | {0: None, 100: 101, 101: 102, 102: 100, 103: 101, 104: 103, 105: 104, 200: 200, 201: 200, 300: 9999, 301: 300, 400: 401, 401: 400}
    assert got(spark, links) == brute(links)


@pytest.mark.parametrize("seed", range(3))
def test_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    n = 150
    links = {k: (None if rng.random() < 0.05 * seed else int(rng.integers(0, n + 10))) for k in range(n)}
    assert got(spark, links) == brute(links)


def test_star_and_rounds(spark, monkeypatch):
    """Many documents that supersede one, and a long chain in few rounds."""
    links = {0: None} | dict.fromkeys(range(1, 500), 0) | {k: k - 1 for k in range(1001, 1700)} | {1000: None}
    cuts = []
    real = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: cuts.append(1) or real(df))
    assert got(spark, links) == brute(links)
    assert len(cuts) <= 14  # 700 links: ten rounds


def test_no_documents(spark):
    assert chains.version_chains(spark.createDataFrame([], "doc_id long, supersedes_id long")).isEmpty()


COLUMNS = "tenant string, chunk_id long, spec string, doc_id long, v double"


def files(spark, path):
    """The files of each bucket."""
    out: dict = {}
    for f in spark.read.parquet(f"{path}/rows").inputFiles():
        out.setdefault(int(f.split("bucket=")[1].split("/")[0]), set()).add(f)
    return out


def rows(spark, path):
    return sorted((r.tenant, r.chunk_id, r.spec, r.v) for r in keyed.read(spark, path).collect())


@pytest.fixture
def table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    held = [("t", k, s, k // 4, float(k)) for k in range(60) for s in ("a", "b")]
    keyed.create(spark.createDataFrame(held, COLUMNS), path, buckets=8)
    return path, held


def test_upsert_rewrites_touched_buckets_only(spark, table):
    path, held = table
    before = files(spark, path)
    batch = [("t", 3, "a", 0, 99.0), ("t", 500, "a", 125, 1.5)]
    touched = keyed.upsert(spark.createDataFrame(batch, COLUMNS), path)
    after = files(spark, path)
    assert 1 <= len(touched) <= 2 and all((before[b] == after[b]) == (b not in touched) for b in before)
    want = {r[:3]: r[4] for r in held} | {r[:3]: r[4] for r in batch}
    assert rows(spark, path) == sorted((*k, v) for k, v in want.items())
    assert keyed.upsert(spark.createDataFrame([], COLUMNS), path) == [] and files(spark, path) == after


def test_bad_batches_change_nothing(spark, table):
    path, _ = table
    before, content = files(spark, path), rows(spark, path)
    with pytest.raises(keyed.BadBatch, match="one spec a batch.*'a', 'b'"):
        keyed.upsert(spark.createDataFrame([("t", 1, "a", 0, 0.0), ("t", 1, "b", 0, 0.0)], COLUMNS), path)
    with pytest.raises(keyed.BadBatch, match="1 keys repeat.*'t', '7', 'a'"):
        keyed.upsert(spark.createDataFrame([("t", 7, "a", 0, 0.0), ("t", 7, "a", 0, 1.0), ("t", 8, "a", 0, 0.0)], COLUMNS), path)
    broken = spark.createDataFrame([("t", 1, "a", 0, 0.0)], COLUMNS).withColumn("v", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        keyed.upsert(broken, path)
    assert files(spark, path) == before and rows(spark, path) == content


def test_delete(spark, table):
    path, held = table
    gone = spark.createDataFrame([("t", 0), ("t", 1), ("u", 2)], "tenant string, doc_id long")
    keyed.delete(spark, path, gone, spec="b")
    want = [r for r in held if not (r[3] in (0, 1) and r[2] == "b")]
    assert rows(spark, path) == sorted((r[0], r[1], r[2], r[4]) for r in want)
    keyed.delete(spark, path, gone)
    assert keyed.delete(spark, path, gone) == []
    want = [r for r in held if r[3] not in (0, 1)]
    assert rows(spark, path) == sorted((r[0], r[1], r[2], r[4]) for r in want)
    keyed.delete(spark, path, spark.createDataFrame([("t", d) for d in range(20)], "tenant string, doc_id long"))
    assert rows(spark, path) == []  # buckets without a row have gone
    keyed.upsert(spark.createDataFrame([("t", 1, "a", 0, 5.0)], COLUMNS), path)
    assert rows(spark, path) == [("t", 1, "a", 5.0)]


def test_keys_are_unique_from_the_start(spark, tmp_path):
    with pytest.raises(keyed.BadBatch):
        keyed.create(spark.createDataFrame([("t", 1, "a", 0, 0.0)] * 2, COLUMNS), f"file://{tmp_path}/bad")
