"""The corpus pipeline against its stages done by hand."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from quillet.llm import mixing, packing, quality_rules
from tests.llm.test_operators import SCHEMA, brute_fingerprint, rows, words


def good(text):
    """The verdict of the threshold table, measure by measure."""
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    n = max(len(w), 1)
    stop = sum(x.lower() in set(quality_rules.STOP_WORDS) for x in w) / n
    symbols = len(re.findall(r"[#*$%&|<>]", text or "")) / n
    repeated = (len(lines) - len(set(lines))) / max(len(lines), 1)
    return len(w) >= 10 and 100 * len(covered) <= 20 * len(w) and 3 <= sum(map(len, w)) / n <= 10 and symbols <= 0.1 and repeated <= 0.3 and stop >= 0.06


def classes(items, same):
    """Groups of items linked by ``same``, directly or not."""
    left, out = list(items), []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            one = todo.pop()
            group.append(one)
            near = [x for x in left if same(one, x)]
            left = [x for x in left if not same(one, x)]
            todo += near
        out.append(group)
    return out


def pieces(docs):
    """(doc_id, piece number, tokens) of what the stages leave of (doc_id, text, source), by hand."""
    kept = [d for d in docs if good(d[1])]
    last = lambda d: (d[0] is None, d[0] or 0)
    exact = [min(g, key=lambda d: (-len(d[1]), last(d))) for g in classes(kept, lambda a, b: words(a[1]) == words(b[1]) or "".join(words(a[1])) == "".join(words(b[1])))]
    prints = {d: brute_fingerprint(d[1]) for d in exact}
    near = [min(g, key=last) for g in classes(exact, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)]
    size = defaultdict(int)
    for d in near:
        size[d[2]] += len(words(d[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(size.values())), set(names)
    while free and left > 1e-9:
        total, share = sum(weight[s] for s in free), left
        left = 0.0
        for s in list(free):
            target[s] += share * weight[s] / total
            if target[s] >= 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                free.discard(s)
    out = []
    for d in near:
        rate = min(3.0, target[d[2]] / size[d[2]])
        draw = int(hashlib.md5(f"{mixing.SEED}:{'null' if d[0] is None else d[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, most = len(words(d[1])) + 1, max(packing.LENGTHS)
        for _ in range(math.floor(rate) + (draw < rate - math.floor(rate))):
            out += [(d[0], k, min(most, n - k * most)) for k in range(-(-n // most))]
    return out


def corpus():
    """Clean prose in several sources, with copies, near copies, repeated and null ids, and what the rules reject."""
    import numpy as np

    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)]
    prose = lambda n: " ".join(("the" if rng.random() < 0.2 else str(rng.choice(vocabulary))) for _ in range(n))
    docs = [(k, prose(int(rng.integers(20, 900))), ["a", "b", None, "c"][k % 4 if k % 4 < 3 else 3]) for k in range(40)]
    docs += [(100 + k, docs[k][1].replace(" ", "  "), "b") for k in range(5)] + [(200 + k, docs[10 + k][1] + " zzz", "c") for k in range(5)]
    docs += [(None, prose(300), "a"), (None, docs[3][1], "a"), (7, prose(120), "c"), (300, prose(9000), "b"), (7, docs[7][1], docs[7][2])]
    return docs + [(400, None, "a"), (401, "too short", "b"), (402, "### " * 50, "b")]


def test_run_by_hand(spark, tmp_path):
    docs = corpus()
    table = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece_no, r.piece_tokens) for r in got) == Counter(pieces(docs))
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for held in bins.values():
        assert sum(r.piece_tokens for r in held) == held[0].bin_tokens <= held[0].capacity


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
