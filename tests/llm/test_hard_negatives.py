"""Hard negatives by vertical scans against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from quillet.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rid long, v string, windows string, block int"


def brute(table, every=100, k=5, share=80):
    rows = []
    for vec_id, x, label in table:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        rows.append((vec_id, label, [math.floor(256 * c) for c in x]))
    out = Counter()
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for i, (a, la, va) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = [(sum(p * q for p, q in zip(va, v)), b, lb) for j, (b, lb, v) in enumerate(rows) if j != i]
        for ps, p, _ in sorted((s for s in scored if s[2] == la), key=first)[:k]:
            inside = [s for s in scored if s[2] != la and share * ps <= 100 * s[0] <= 100 * ps]
            for rank, (ns, n, _) in enumerate(sorted(inside, key=first)[:k], 1):
                out[a, p, rank, n, ps, ns] += 1
    return out


def table(kind):
    rng = np.random.default_rng({"plain": 1, "ties": 2, "dirty": 3}[kind])
    if kind == "plain":
        return [(k, list(map(float, rng.normal(size=24))), int(rng.integers(10))) for k in range(700)]
    if kind == "ties":  # few different vectors, one of them very common
        few = rng.integers(-2, 3, (6, 8)) / 4
        return [(k, list(map(float, few[min(int(rng.integers(12)), 5)])), int(rng.integers(3))) for k in range(900)]
    out = [(k, list(map(float, rng.integers(-3, 4, int(rng.integers(0, 9))) / 8)), int(rng.integers(4))) for k in range(500)]
    out += [(100, [0.5] * 5, 1), (100, [0.5] * 5, 1), (100, None, 1), (200, [0.5, None], 2), (300, [float("nan")], 1), (300, [float("inf"), 1.0], 1), (400, [0.5] * 6, None)]
    return out + [(None, [0.4] * 6, 1), (None, [0.4] * 6, 2), (None, [0.4] * 6, 3), (-100, [0.25] * 7, 2), (7000, [], 3)]


@pytest.mark.parametrize("kind", ["plain", "ties", "dirty"])
@pytest.mark.parametrize("blocks", [(4096, 512), (64, 3)])
def test_mine_by_brute_force(spark, kind, blocks):
    rows = spark.createDataFrame([(i, x, label, 1, "v", "w", 0) for i, x, label in table(kind)], SCHEMA).repartition(3)
    got = hard_negatives.mine(rows, block_vectors=blocks[0], block_anchors=blocks[1]).collect()
    want = brute(table(kind))
    assert want and Counter(map(tuple, got)) == want


def test_other_parameters(spark):
    rows = spark.createDataFrame([(i, x, label) for i, x, label in table("plain")], "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(rows, every=50, k=3, share=50, block_vectors=100, block_anchors=4).collect()
    assert Counter(map(tuple, got)) == brute(table("plain"), 50, 3, 50)
    with pytest.raises(ValueError):
        hard_negatives.mine(rows, k=9)


def test_large_components_are_clamped(spark):
    rows = spark.createDataFrame([(100, [1e300, -1e300], 1), (1, [1e300, -1e300], 1), (2, [1e300, -1e299], 2), (3, [1.0, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(rows).collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id, r.positive_score == r.negative_score) for r in got] == [(100, 1, 2, True)]


def test_scan_leaves_out_what_cannot_count():
    """Where magnitudes are uneven the bounds clear most of the bitmap long before the last dimension."""
    rng = np.random.default_rng(4)
    scale = 2.0 ** -np.arange(64)[rng.permutation(64)] * 1e4
    cols = np.floor(rng.normal(size=(64, 5000)) * scale[:, None])
    anchor = np.floor(rng.normal(size=64) * scale)
    read: list[int] = []
    [(at, score)] = hard_negatives.scan(anchor, cols, cols.min(1), cols.max(1), np.ones(5000, bool), np.arange(5000), [(-(2**62), 2**62)], 5, read)
    exact = (anchor @ cols).astype(np.int64)
    assert list(at) == list(np.lexsort((np.arange(5000), -exact))[:5]) and list(score) == list(exact[at])
    assert sum(read) < 0.3 * cols.size


def test_empty(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_cell_holds_bounded_blocks_and_gives_k_rows_an_anchor(spark, monkeypatch):
    """However many blocks of vectors there are, a task gets ``CELL`` of them and hands on ``k`` rows an anchor and window."""
    monkeypatch.setattr(hard_negatives, "CELL", 2)
    table = hard_negatives.cut(hard_negatives.vectors(spark.createDataFrame([(i, [float(i % 7), float(i % 11)], i % 3) for i in range(300)], "vec_id long, embedding array<double>, label int")))
    rows = table.selectExpr("*", "cast(array() as array<bigint>) as windows")
    blocks, anchors = hard_negatives.packed(rows, 30), hard_negatives.packed(rows.filter("vec_id = 100"), 1)
    cell = hard_negatives._scan_cells(False, 2, 80)
    named = lambda df, p: df.toDF(*[p + c for c in df.columns]).toArrow()
    found = cell(named(anchors, "a_"), named(blocks, "v_"))
    assert found.num_rows == 2  # a block each gave two before: sixty
    found = hard_negatives._search(rows.filter("vec_id = 100"), blocks, 1, 30, False, 2, 80)
    assert found.count() == 2
