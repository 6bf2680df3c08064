"""The filter interaction audit against a brute-force run of every order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from quillet.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, part string, mask string, good string"


def table():
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "GAMMA", "delta#", "eps", "é", "𝒳y"] + [f"w{k}" for k in range(70)]
    out = [(0, None, None), (1, "", "a"), (2, None, ""), (3, " \t", "a"), (None, "no id", "a"), (None, "no id", "a"), (4, "no id", "b"), (4, "no id", "a"), (5, "no id", "a")]
    out += [(6, "long " * 9000, "b"), (7, "long " * 9000 + "X", "b")]
    for k in range(8, 90):
        out.append((k, " ".join(rng.choice(words, int(rng.integers(1, 75)), replace=bool(k % 2))) if k % 2 or k % 4 else "Copy | of one", ["a", "b", "c"][k % 3]))
    return out


TABLE = table()


def rows():
    return [(d, t, "en", s, 0, "x", "y", "z", "w") for d, t, s in TABLE]


LABELS = [(k, k % 2, (k // 2) % 2) for k in range(0, 80)] + [(4, None, 1), (8, 1, None), (None, 1, 1), (500, 1, 1)]


def brute():
    good, toxic = ({d for d, *x in LABELS if d is not None and x[i] == 1} for i in (0, 1))
    smallest = {}
    for d, t, _ in TABLE:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    fails, parts = [], defaultdict(list)
    for k, (d, t, s) in enumerate(TABLE):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > smallest[t])
        fails.append({x for x, bad in zip("ABCDE", tests) if bad})
        parts[s or ""].append(k)
    out, shapley = {}, Counter()
    for part, own in parts.items():
        for order in permutations("ABCDE"):
            alive = set(own)
            for step, letter in enumerate(order, 1):
                failing = {k for k in own if letter in fails[k]}
                gone = failing & alive
                alive -= gone
                lost = [sum(TABLE[k][0] in which for k in gone) for which in (good, toxic)]
                out[part, "".join(order), step] = [len(alive), len(gone), len(failing - gone), sum(fails[k] == {letter} for k in own), *lost]
                shapley[part, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark.createDataFrame(rows(), SCHEMA).repartition(3), labels).collect()
    assert len(got) == 4 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute()


def test_shapley_adds_up(spark):
    """Over one order, what the filters remove and what is left make the part."""
    got = filter_audit.audit(spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    sizes = Counter(s or "" for _, _, s in table())
    for part, n in sizes.items():
        ends = {r.kept for r in got if r.part == part and r.step == 5}
        assert len(ends) == 1 and sum(r.removed for r in got if r.part == part and r.filter_order == "ABCDE") == n - ends.pop()
        assert sum({r.filter_order[r.step - 1]: r.shapley for r in got if r.part == part}.values()) == sum(r.removed for r in got if r.part == part)


def test_hot_text_and_own_filters(spark):
    """A text that nearly all rows share, and filters of one's own."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 50 = 0, concat('Own ', id), 'the same') AS text", "'s' AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, {"Z": "_text rlike '^Own'"}, "Y").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in got} == {
        ("ZY", 1): (2940, 60, 120), ("ZY", 2): (1, 2939, 5878), ("YZ", 1): (61, 2939, 5878), ("YZ", 2): (1, 60, 120),
    }
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {"Y": "true"}, "Y")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
