"""The training-data operators against brute force, edge cases included."""

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillet.llm import block_naming, components, license_scan, lm_scoring, mixing, packing, quality_rules, simhash, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, w string, _words string"
LONG = "alpha beta gamma delta " * 3000
SHARED = "a passage that many documents share and that is well over one hundred bytes long so that it must be found again "


def rows():
    texts = [
        None, "", " \t\n", "one", "one two", "the same text here for a test of copies", "the  same text here\nfor a test of copies", "the same text here for a test of copies",
        "Released under the MIT License. GNU General Public License, version 3. cc by", "MIT license " * 50, LONG, LONG + "omega", SHARED + "first ending", "other start " + SHARED,
        "x" * 350, "The the THE the " * 40, "#$%&|<> ### *** a b c d e f g h i j k", "line one is here\nline one is here\nline two is here for the fun of it\n\n",
    ]
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé"), 4)) for _ in range(400)]
    base = list(rng.choice(words, 600))
    texts.append(" ".join(base))
    for k in range(6):
        near = list(base)
        near[int(rng.integers(600))] = f"new{k}"
        texts.append(" ".join(near))
    out = [(k, t, "en", ["src0", "src0", "src1", None][k % 4], len(t or ""), "clash", "clash", "clash") for k, t in enumerate(texts)]
    return [*out, (5, texts[5], "en", "src0", 5, "clash", "clash", "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, block, weak):
    options = {"key": lambda c: F.struct((F.length(c) % 5).alias("h"))} if weak else {}
    got = block_naming.exact_groups(docs, block_chars=block, **options).collect()
    groups = defaultdict(list)
    for r in rows():
        groups["".join(words(r[1]))].append((-len(r[1] or ""), r[0]))
    assert len(got) == len(rows()) and sum(r.kept for r in got) == len(groups)
    by_id = {r[0]: "".join(words(r[1])) for r in rows()}
    for r in got:
        bare = by_id[r.doc_id]
        assert (r.keep_id, r.group_size) == (min(groups[bare])[1], len(groups[bare]))
        assert r.text_sha256 == hashlib.sha256(bare.encode()).hexdigest()


def test_drop_exact_copies_keeps_columns(docs):
    out = block_naming.drop_exact_copies(docs)
    assert out.columns == docs.columns and out.count() == len({"".join(words(r[1])) for r in rows()})


def test_row_keeping_with_null_and_repeated_ids(spark):
    """One row of each class stays, whatever the ids; the columns of the row stay with it."""
    schema = "rid long, doc_id long, text string, source string, name string, row string"
    table = [(1, 5, "uniq a"), (2, 5, "copy b"), (3, 1, "copy  b"), (4, 6, "w  s"), (5, 6, "w s"), (6, None, "n u l l"), (7, None, "n u l l"), (8, None, "alone"), (9, 7, "w\ts"), (10, None, None), (11, 8, "")]
    df = spark.createDataFrame([(*r, "s", "n", "r") for r in table], schema).repartition(3)
    exact = block_naming.drop_exact_copies(df)
    assert exact.columns == df.columns
    kept = sorted(r.rid for r in exact.collect())
    assert kept == [1, 3, 4, 6, 8, 11] or kept == [1, 3, 4, 7, 8, 11]
    near = simhash.keep_representatives(df)
    assert near.columns == df.columns
    got = near.collect()
    classes = defaultdict(list)
    for rid, doc_id, text in table:
        classes[brute_fingerprint(text)].append((doc_id is None, doc_id or 0, rid))
    assert len(got) == len(classes)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(min(c)[:2] for c in classes.values())


def test_hot_group_of_copies(spark):
    df = spark.createDataFrame([(k, "same text" if k % 3 else f"text {k}") for k in range(120)], "doc_id long, text string")
    got = {r.doc_id: r for r in block_naming.exact_groups(df).collect()}
    assert all((r.keep_id, r.group_size) == ((1, 80) if k % 3 else (k, 1)) for k, r in got.items()) and sum(r.kept for r in got.values()) == 41


def test_quality(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for r in rows():
        w, lines = words(r[1]), [x for x in (r[1] or "").split("\n") if words(x)]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        g = got[r[0]]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), len(covered))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == expected
        assert g.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (g.base_failed and g.kept)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, g in got.items() if g.kept}
    assert {r.row["_words"] for r in quality_rules.measures(docs).collect()} == {"clash"}


def test_quality_rules_fire(spark):
    texts = {
        "n_words": "the and of", "repeat_words": "all the same words here " * 5, "mean_word_chars": "a b c d e f g h i the of and", "symbols": "the word### and other *** of the more one to three four",
        "duplicate_lines": "the cat of olden\nthe cat of olden\nand one thing to see now there", "stop_words": "ninety seven other words stand about without little common helpers anywhere near",
        "": "the cat and the dog went to a house of stone by the river where he was",
    }
    texts["mean_word_chars_"] = " ".join(["extraordinarily", "incomprehensible", "the", "internationalisation"] + [f"{c}ounterrevolutionary" for c in "abcdefg"])
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    for name, r in got.items():
        assert (name.rstrip("_") in r.failed_rules.split(",")) and r.kept == (name == ""), (name, r)
    assert got["duplicate_lines"].failed_rules == "duplicate_lines" and got["symbols"].failed_rules == "symbols" and got["stop_words"].failed_rules == "stop_words"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum((sum(x >> k & 1 for x in h) * 2 > len(h)) << k for k in range(64))


@pytest.mark.parametrize("group", [2048, 1])
def test_simhash(docs, group):
    got = simhash.near_duplicates(docs, group=group).collect()
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows()}
    near = {a: {b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3} for a in prints}
    reach = {a: {a} for a in prints}
    for _ in prints:
        reach = {a: set().union(*(near[b] for b in r)) for a, r in reach.items()}
    assert len(got) == len(rows())
    for r in got:
        assert (r.fingerprint, r.component_id) == (format(prints[r.doc_id], "016x"), min(reach[r.doc_id]))


@pytest.mark.parametrize("group", [2048, 1])
def test_simhash_links_of_two(spark, group):
    """Pairs that meet nobody else, with the sign bit among the differing bits; the last ones are too far apart."""
    near = [(63,), (63, 0), (63, 1), (63, 0, 1), (63, 5, 40), (62, 63, 3), (0, 1, 2)]
    far = [(63, 0, 1, 2), tuple(range(3, 64))]
    rng = np.random.default_rng(7)
    pairs, expected = [], set()
    for k, bits in enumerate([*near, *far]):
        a = int(rng.integers(0, 1 << 62))
        b = a ^ sum(1 << x for x in bits)
        pairs += [a, b]
        if k < len(near):
            expected.add(frozenset((a, b)))
    signed = np.array(pairs, np.uint64).view(np.int64).tolist()
    assert all((x ^ y).bit_count() > 3 for x in pairs for y in pairs if x != y and frozenset((x, y)) not in expected)
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), group=group).collect()
    assert {frozenset(x % (1 << 64) for x in (r.a, r.b)) for r in got} == expected


def test_simhash_agrees_with_spark_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab é cd"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("ab é cd".encode(), 42)).astype(np.int64)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_of_a_star(spark):
    """The edges of a node that a third of all nodes touch are spread over the tasks, and the result stays right."""
    star = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(30_000, 30_400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = star.unionByName(chain).repartition(8)
    for many in (100, 10**9):
        roots = {r.node: r.root for r in components.connected_components(edges, many).collect()}
        assert len(roots) == 20_001 + 401 and all(r == (0 if n <= 20_000 else 30_000) for n, r in roots.items())
    turned = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    linked, _ = components._with_least(turned, 100)
    sizes = [r["count"] for r in linked.filter("u = 0").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 5_000


def test_mixing(docs):
    got = mixing.plan(docs).collect()
    size = {r[0]: len(words(r[1])) for r in rows()}
    of = defaultdict(int)
    for r in rows():
        of[r[3]] += len(words(r[1]))
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = float(sum(of.values())), set(names)
    while open_ and left > 1e-6:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 3 * of[s]:
                left += target[s] - 3 * of[s]
                target[s] = 3.0 * of[s]
                open_.discard(s)
    by_size = {of[s]: target[s] for s in names}
    assert len(got) == len(rows())
    for r in got:
        assert r["size"] == size[r.doc_id] and r.taken == r["size"] * r.copies <= 3 * r["size"]
        assert r.target == pytest.approx(by_size[r.source_size])
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_running_sums_by_brute_force(spark):
    rng = np.random.default_rng(6)
    table = [(None if k % 40 == 0 else int(rng.integers(30)), int(rng.integers(100))) for k in range(500)]
    df = spark.createDataFrame(table, "x long, v long").repartition(5)
    got = sorted(((r.x is None, r.x or 0), r.v, r.total, r.n) for r in mixing.running(df, "x", {"total": F.col("v"), "n": F.lit(1)}).collect())
    key = lambda x: (x is None, x or 0)
    want = sorted((key(x), v, sum(w for y, w in table if key(y) <= key(x)), sum(key(y) <= key(x) for y, _ in table)) for x, v in table)
    assert got == want


def test_packing(docs):
    got = packing.pack_documents(docs, lengths=(16, 64, 256)).collect()
    assert sum(r.piece_tokens for r in got) == sum(len(words(r[1])) + 1 for r in rows())
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id, r.capacity, r.bin_tokens].append((r.bin_offset, r.piece_tokens))
    for (_, capacity, tokens), pieces in bins.items():
        pieces.sort()
        assert tokens == sum(n for _, n in pieces) <= capacity and capacity == next(c for c in (16, 64, 256) if c >= tokens)
        assert [a for a, _ in pieces] == np.cumsum([0] + [n for _, n in pieces[:-1]]).tolist()


def test_packing_near_the_best():
    rng = np.random.default_rng(0)
    sizes = sorted(rng.integers(1, 60, 4000).tolist(), reverse=True)
    _, contents, final = packing.pack_shard(sizes, (16, 32, 64))
    assert sum(contents) == sum(sizes) and sum(final) < 1.05 * sum(sizes)


def least_cost(sizes, lengths, cost):
    """The cheapest of all ways to put the sizes into bins."""
    best = float("inf")

    def place(k, bins):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(cost(next(c for c in lengths if c >= b)) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= lengths[-1]:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


def test_packing_against_the_optimum():
    """Against exhaustive search on small cases, under costs that make the lengths compete."""
    rng = np.random.default_rng(4)
    ratios, opened = [], set()
    for case in range(120):
        lengths = ((4, 6, 10), (8, 12, 20), (5, 9, 16))[case % 3]
        power = (1.0, 1.15)[case % 2]
        cost = lambda c, power=power: c**power
        sizes = sorted(rng.integers(1, lengths[1], 7).tolist(), reverse=True)
        where, contents, final = packing.pack_shard(sizes, lengths, cost)
        assert [sum(s for s, w in zip(sizes, where, strict=True) if w == b) for b in range(len(contents))] == contents
        opened |= set(final)
        ratios.append(sum(map(cost, final)) / least_cost(sizes, lengths, cost))
    assert min(ratios) >= 1 - 1e-9 and np.mean(ratios) < 1.04 and max(ratios) < 1.35 and len(opened) == 9


def test_packing_lengths_compete():
    """Two threes share a six although a four would hold one; alone, a three takes the four."""
    linear = lambda c: c
    assert packing.pack_shard([3] * 8, (4, 6), linear)[2] == [6] * 4
    assert packing.pack_shard([3], (4, 6), linear)[2] == [4]
    assert sorted(packing.pack_shard([9, 3], (4, 6, 10), linear)[2]) == [4, 10]
    assert packing.pack_shard([5, 5, 3, 3, 3, 1], (4, 6, 10), packing.training_cost)[2] == [10, 10]


def brute_removed(texts):
    seen, out = set(), {}
    for k, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        out[k] = (b, gone)
    return out


def check_removed(got, texts):
    """``texts``: (doc_id, text) in the order in which strings are judged."""
    expected = brute_removed(list(enumerate(t for _, t in texts)))
    left = defaultdict(list)
    for k, (doc_id, _) in enumerate(texts):
        b, gone = expected[k]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left[doc_id].append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    mine = defaultdict(list)
    for r in got:
        mine[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in left.items()}


def test_suffix_dedup(docs):
    check_removed(suffix_dedup.remove_repeats(docs).collect(), sorted(((r[0], r[1]) for r in rows()), key=lambda r: r[0]))


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_suffix_dedup_unique_ids(spark, monkeypatch, chunk):
    unique = sorted({r[0]: r[1] for r in rows()}.items())
    if chunk == 3:  # in this process, as tasks would
        monkeypatch.setattr(suffix_dedup, "_CHUNK", chunk)
        monkeypatch.setattr(suffix_dedup, "_COMBINE", 2)
        check_removed(by_hand(unique), unique)
        return
    check_removed(suffix_dedup.remove_repeats(spark.createDataFrame(unique, "doc_id long, text string").repartition(5)).collect(), unique)


def by_hand(texts):
    """The steps of remove_repeats without Spark, for settings that tasks would not see."""
    import pyarrow as pa
    from pyspark.sql import Row

    seen, copies = set(), []
    for k, t in texts:
        copies.append(t in seen)
        seen.add(t)
    of = lambda **c: pa.RecordBatch.from_pydict(c)
    keys, words = [k for k, _ in texts], [t or "" for _, t in texts]
    owned = [r for b in suffix_dedup._find_owners([of(key=keys, text=words, copy=copies)]) for r in b.to_pylist()]
    route = lambda r: (r["key"], r["at"]) if r["at"] & suffix_dedup._LATER else r["h"]
    n = Counter(map(route, owned))
    places = defaultdict(list)
    for r in owned:
        if r["at"] & suffix_dedup._SEVERAL or n[route(r)] > 1:
            places[r["key"]].append({"h": r["h"], "at": r["at"] & ~(suffix_dedup._SEVERAL | suffix_dedup._LATER)})
    text = dict(zip(keys, words, strict=True))
    some = [k for k in keys if places[k]]
    around = list(suffix_dedup._surroundings(of(key=[k], text=[text[k]], places=[places[k]]) for k in some))
    rows_ = sorted((r for b in around for r in b.to_pylist()), key=lambda r: r["route"])
    spans = defaultdict(list)
    batches = [pa.RecordBatch.from_pylist(rows_[k : k + 7], schema=around[0].schema) for k in range(0, len(rows_), 7)]
    for b in suffix_dedup._removed(batches):
        for r in b.to_pylist():
            spans[r["key"]].append({"start": r["start"], "end": r["end"]})
    out = suffix_dedup._apply([of(key=keys, text=words, copy=copies, spans=[spans[k] for k in keys])])
    return [Row(**r) for b in out for r in b.to_pylist()]


def test_suffix_dedup_null_and_repeated_ids(spark):
    """Rows are documents of their own, whatever their ids; which of two rows of one id comes first is free."""
    rng = np.random.default_rng(9)
    long = ["".join(rng.choice(list("abcdefgh "), 300)) for _ in range(2)]
    table = [(None, long[0]), (None, long[1]), (None, SHARED * 2), (2, SHARED), (2, "short"), (3, long[0] + "x"), (3, long[0] + "x"), (3, ""), (None, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(table)
    by = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in got)
    n, m = len(SHARED.encode()), len(long[0])
    assert by == sorted([
        (False, 2, 5, 0), (False, 2, n, 0), (False, 3, 0, 0), (False, 3, m + 1, 0), (False, 3, m + 1, m + 1),
        (True, 0, 0, 0), (True, 0, len(long[1]), 0), (True, 0, m, m), (True, 0, 2 * n, 2 * n),
    ])


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_ranks_are_those_of_a_plain_sort(letters):
    rng = np.random.default_rng(5)
    data = bytes(rng.choice(list(letters.encode()), 3000, p=[0.97] + [0.03 / (len(letters) - 1)] * (len(letters) - 1)))
    data += b"a" * 200 + data[:900] + bytes(8)
    starts = rng.permutation(np.arange(0, len(data) - 110))
    segment = np.sort(rng.integers(0, 4, len(starts)))
    got = suffix_dedup.ranks(data, starts, segment)
    string = lambda i: (segment[i], data[starts[i] : starts[i] + 100])
    by = sorted(range(len(starts)), key=string)
    first, expected = {}, np.empty(len(starts), np.int64)
    for at, i in enumerate(by):
        expected[i] = first.setdefault(string(i), at)
    assert (got == expected).all()


def test_blind_trie_orders_suffixes():
    rng = np.random.default_rng(5)
    data = bytes(rng.choice(list(b"ab"), 3000, p=[0.97, 0.03])) + b"a" * 200
    starts = list(range(0, 2900, 3))
    classes = suffix_dedup.blind_trie(data, starts)
    strings = [{data[starts[i] : starts[i] + 100] for i in c} for c in classes]
    assert all(len(s) == 1 for s in strings)
    flat = [min(s) for s in strings]
    assert flat == sorted(flat) and len(set(flat)) == len(flat)


LICENCE_TEXTS = [
    *(f"Copyright 2020 Ann. {p.text} Further words." for p in license_scan.PASSAGES),
    " ".join(p.text for p in license_scan.PASSAGES if p.label == "mit" and not p.base),
    " ".join(p.text for p in license_scan.PASSAGES if p.label.startswith("bsd")),
    "permission is hereby granted free of charge but the rest is another text altogether",
    "Permission is hereby granted, free of charge, to any company obtaining a copy of this program and associated documentation files",
    "the m\u212at license and the M\u0130T LICENSE are not what they seem, MIT\u00a0License neither",
    "endorse redistributions merchantability noninfringement sublicense " * 30,
]


def brute_licences(table, passages):
    """What the scan gives for each text, by plain loops over all places of all passages."""
    split = {k: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, t in table}
    of_passage = [license_scan.plain_words(p.text) for p in passages]
    count = lambda w: sum(w in words for words in split.values())
    rarity = {w: np.log((1 + len(split)) / (1 + count(w))) for words in of_passage for w in words}
    by = lambda words, n: sorted(set(words), key=lambda w: (-rarity[w], w))[:n]
    indexed = [by(words, 1 if p.base else license_scan.INDEXED) for p, words in zip(passages, of_passage, strict=True)]
    own = {w for p, words in zip(passages, indexed, strict=True) if not p.base for w in words}
    out = {}
    for doc, w in split.items():
        looked = by([x for x in w if x in own], license_scan.LOOKUPS)
        base, labels, score = [], set(), 0.0
        for p, words, index in zip(passages, of_passage, indexed, strict=True):
            key = p.key.split()
            at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
            mine = [k for k, x in enumerate(words) if x in index and (p.base or x in looked)]
            size = sum(x in index for x in words)
            for s in range(-len(words), len(w)):
                n = sum(0 <= s + k < len(w) and w[s + k] == words[k] for k in mine)
                if s + at < 0 or w[s + at : s + at + len(key)] != key or n < min(license_scan.LEAST, size) or n < license_scan.AGREE * len(mine):
                    continue
                labels.add(p.label)
                if p.base:
                    base.append((s, p.label))
                score = max(score, 0.5 if p.base else n / len(mine))
        places = [s for s, _ in base]
        out[doc] = (len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9))
    return out


def test_licenses(spark, docs):
    passages = license_scan.PASSAGES
    texts = {r[0]: r[1] for r in rows()} | {100 + k: t for k, t in enumerate(LICENCE_TEXTS)}
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(LICENCE_TEXTS)], "doc_id long, text string")
    got = license_scan.scan(docs.select("doc_id", "text").distinct().unionByName(extra)).collect()
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got}
    expected = brute_licences(list(texts.items()), passages)
    assert found == expected
    assert all(p.label in found[100 + k][5].split(",") for k, p in enumerate(passages))
    assert found[100 + len(passages) + 4][4] == "" and "mit" not in found[100 + len(passages) + 2][5]


def brute_text(page):
    """Text of a page, character by character."""
    import html

    out, i, low = [], 0, page.lower()
    while i < len(page):
        if page[i] != "<":
            out.append(page[i])
            i += 1
            continue
        if low.startswith("<!--", i):
            end = low.find("-->", i + 4)
            out.append(" ")
            i = end + 3 if end >= 0 else len(page)
            continue
        end, again = page.find(">", i), page.find("<", i + 1)
        inside = page[i + 1 : end].lower()
        if end < 0 or 0 <= again < end or not (inside[:1] in ("!", "?") or re.match("/?[a-z]", inside)):
            out.append("<")
            i += 1
            continue
        i = end + 1
        name = re.match("/?([^\\s/]*)", inside)[1]
        if name in warc._BREAKS:
            out.append("\n")
        elif name in ("script", "style", "noscript", "template", "title") and inside[0] != "/":
            out.append(" ")
            ends = [k for k in range(i, len(page)) if low.startswith(f"</{name}", k) and not re.match("[\\w-]", low[k + len(name) + 2 :] or " ")]
            i = ends[0] if ends else len(page)
    lines = [re.sub("[^\\S\n]+", " ", x).strip() for x in html.unescape("".join(out)).split("\n")]
    return "\n".join(x for x in lines if x)


PAGES = [
    (1, "http://a/x", "<html lang=en><title>T &amp; u</title><p>Hi<script>x</script> there<a href='/l'>l</a>"),
    (2, None, None),
    (3, "http://a/y", ""),
    (4, "http://a/z", "a < b &lt;c&gt; <b>bold</b><!-- gone <p> --> and <!-- never closed <p>x"),
    (5, "http://a/w", "<SCRIPT src=x>var a='</b>';</SCRIPT >after<style>p{}</stylex></style>end<br/>line<a data-href=no HREF = \"/q?a=1&amp;b=2\">q</a>"),
    (6, "http://a/v", "<?xml v?><!DOCTYPE html><div>one</div>two<p class=a>three <a name=x>four</a><title>late"),
    (1, "http://a/x", "<html lang=en><title>T &amp; u</title><p>Hi<script>x</script> there<a href='/l'>l</a>"),
    (None, None, "no id"),
]


def test_warc(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, key string, payload string").repartition(3)
    responses = warc.responses_of_pages(pages)
    source = {r.record_id: r for r in responses.collect()}
    got = warc.derive(responses).collect()
    assert len(source) == len(PAGES) and len(got) == 2 * len(PAGES) == len({r.record_id for r in got})
    assert {r.refers_to for r in got} == set(source)
    for r in got:
        of = source[r.refers_to]
        assert (r.target_uri, r.warc_date, r.http_headers, r.payload_digest) == (of.target_uri, of.warc_date, of.http_headers, warc.digest(bytes(of.payload or b"")))
        assert r.content_length == len(r.block.encode()) and r.block_digest == warc.digest(r.block.encode())
        if r.warc_type == "conversion":
            assert r.block == brute_text(bytes(of.payload or b"").decode())
    meta = {r.page_id: __import__("json").loads(r.block) for r in got if r.warc_type == "metadata"}
    assert (meta[1]["title"], meta[1]["lang"], meta[1]["links"]) == ("T & u", "en", ["/l"]) and meta[5]["links"] == ["/q?a=1&b=2"] and meta[6]["title"] is None
    assert meta[2]["http_headers"]["Content-Length"] == "0"
    written = [bytes(r.record) for r in warc.serialized(warc.derive(responses)).collect()]
    for data in (b"".join(written), b"".join(map(gzip.compress, written))):
        parsed = list(warc.from_bytes(data))
        assert sorted((h["warc-record-id"], h["warc-refers-to"], b.decode()) for h, b, _ in parsed) == sorted((r.record_id, r.refers_to, r.block) for r in got)
        assert all(h["x-source-status"] == "HTTP/1.1 200 OK" and h["x-source-content-type"] == "text/html; charset=utf-8" and fault is None for h, _, fault in parsed)
    again = {r.record_id for r in warc.derive(warc.responses_of_pages(pages.dropDuplicates(["page_id", "html"]))).collect()}
    assert again == {r.record_id for r in warc.derive(warc.responses_of_pages(pages.dropDuplicates(["page_id", "html"]).repartition(2))).collect()}


def test_read_warc(spark, tmp_path):
    import gzip

    def record(kind, n, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: http://b/{n}\r\nWARC-Date: 2024-02-0{n}T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    body = "<p>caf\u00e9</p>\r\n\r\n<p>two</p>".encode()
    made = [record("warcinfo", 1, b"software: x"), record("response", 2, b"HTTP/1.1 404 Not Found\r\nX-A: b: c\r\n\r\n" + body), record("request", 3, b"GET /")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "b.warc").write_bytes(b"".join(made))
    (tmp_path / "c.warc").write_bytes(b"")
    responses = warc.read_warc(spark, str(tmp_path))
    assert [(r.record_id, r.target_uri, bytes(r.payload), r.fault) for r in responses.collect()] == [("<urn:uuid:2>", "http://b/2", body, None)] * 2
    text = [r for r in warc.derive(responses).collect() if r.warc_type == "conversion"][0]
    assert text.block == "caf\u00e9\ntwo" and ("X-A", "b: c") in warc.header_lines(text.http_headers)


def warc_record(block, n=1, kind="response", length=None, case=str, more=""):
    head = f"WARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: http://b/{n}\r\n{more}Content-Length: {len(block) if length is None else length}\r\n"
    return b"WARC/1.0\r\n" + case(head).encode() + b"\r\n" + block + b"\r\n\r\n"


def http(body, *headers):
    return ("\r\n".join(["HTTP/1.1 200 OK", *headers]) + "\r\n\r\n").encode() + body


def test_warc_charsets_and_encodings(spark, tmp_path):
    """The digest is that of the bytes, the text that of the page, whatever its charset and encodings."""
    import gzip
    import zlib

    page = "<p>caf\u00e9 \u00fcber</p>"
    latin, raw = page.encode("latin-1"), zlib.compressobj(wbits=-15)
    chunked = lambda b: b"".join(b"%x;ext=1\r\n%b\r\n" % (len(b[k : k + 7]), b[k : k + 7]) for k in range(0, len(b), 7)) + b"0\r\n\r\n"
    bodies = [
        (latin, latin, "Content-Type: text/html; charset=ISO-8859-1"),
        (b'<meta charset="latin-1">' + latin, b'<meta charset="latin-1">' + latin, "content-type: text/html"),
        (page.encode("utf-16"), page.encode("utf-16"), "Content-Type: text/html; charset=utf-8"),
        (gzip.compress(latin), gzip.compress(latin), "Content-Type: text/html; Charset='latin-1'\r\nContent-Encoding: GZIP"),
        (zlib.compress(page.encode()), zlib.compress(page.encode()), "Content-Encoding: deflate"),
        (b, b, "Content-Encoding: deflate") if (b := raw.compress(page.encode()) + raw.flush()) else (),
        (chunked(page.encode()), page.encode(), "Transfer-Encoding: chunked"),
        (chunked(gzip.compress(page.encode())), gzip.compress(page.encode()), "Transfer-Encoding: chunked\r\nContent-Encoding: gzip"),
    ]
    made = [warc_record(http(body, headers), n, more=f"WARC-Payload-Digest: sha1:P{n}\r\nWARC-Block-Digest: sha1:B{n}\r\n") for n, (body, _, headers) in enumerate(bodies)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x, mtime=0) for x in made))
    got = warc.derive(warc.read_warc(spark, str(tmp_path))).collect()
    assert len(got) == 2 * len(bodies)
    for r in got:
        n = int(r.refers_to[10:-1])
        assert r.payload_digest == warc.digest(bodies[n][1]) and r.fault is None
        assert (r.source_payload_digest, r.source_block_digest) == (f"sha1:P{n}", f"sha1:B{n}")
        if r.warc_type == "conversion":
            assert r.block == "caf\u00e9 \u00fcber"
    record = bytes(warc.serialized(spark.createDataFrame(got[:1], warc.SCHEMA)).first().record)
    assert b"X-Source-WARC-Payload-Digest: sha1:P" in record


def test_warc_damage(spark, tmp_path):
    """Damaged records are rows with a fault; the others of the file are read."""
    import gzip

    good = warc_record(http(b"<p>one</p>"), 1, case=str.lower)
    bad_gzip = bytearray(gzip.compress(warc_record(http(b"<p>gone</p>" * 50), 2), mtime=0))
    bad_gzip[30:60] = b"\x00" * 30
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good, mtime=0) + bytes(bad_gzip) + gzip.compress(warc_record(http(b"<p>three</p>"), 3), mtime=0))
    (tmp_path / "b.warc").write_bytes(warc_record(http(b"<p>four</p>"), 4) + warc_record(http(b"x"), 5, length="many"))
    (tmp_path / "c.warc").write_bytes(warc_record(http(b"<p>six, cut</p>"), 6)[:-8])
    (tmp_path / "d.warc").write_bytes(b"no record at all")
    (tmp_path / "e.warc").write_bytes(warc_record(http(b"zz\r\nnot chunks", "Transfer-Encoding: chunked"), 7) + warc_record(http(b"no gzip", "Content-Encoding: gzip"), 8) + warc_record(http(b"br", "Content-Encoding: br", "Content-Type: x; charset=klingon"), 9))
    read = warc.read_warc(spark, str(tmp_path))
    faults = {r.record_id and int(r.record_id[10:-1]): (r.fault, r.payload is None) for r in read.collect()}
    assert faults.pop(None) == ("a gzip member is damaged", True)
    assert faults == {n: (None, False) for n in (1, 3, 4, 7, 8, 9)} | {5: ("a record has no length", True), 6: ("a record is cut short", False)}
    got = {int(r.refers_to[10:-1]): r for r in warc.derive(read).collect() if r.warc_type == "conversion"}
    assert {n: r.fault for n, r in got.items()} == {
        1: None, 3: None, 4: None, 6: "a record is cut short", 7: "chunks are damaged", 8: "the body is damaged", 9: "no way to undo br",
    }
    assert got[1].block == "one" and got[3].block == "three" and got[8].block == "no gzip"


def test_warc_long_pages_are_read_in_one_pass():
    import time

    for junk in ("<!--", "<script ", "<title ", "<a ", "<html ", "<!-- ", "<", "<a href = ", "<a href  ", "</script ", "<script>", "&", "<style></styl"):
        start = time.process_time()
        warc.scan_page(junk * (1_000_000 // len(junk)))
        assert time.process_time() - start < 5


def test_toxicity_learns(spark):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    data = []
    for k in range(900):
        w = list(rng.choice(plain, 60))
        if k % 5 == 0:
            w[int(rng.integers(60))] = "vile"
        data.append((k, " ".join(w), "en", "s", 0, "", "", "", int(k % 5 == 0)))
    docs = spark.createDataFrame(data, SCHEMA + ", toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", "toxic"))).collect()
    right = [(r.score > 0.5) == (r.doc_id % 5 == 0) for r in got if r.held_out]
    assert np.mean(right) > 0.95 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def brute_ftrl(texts, labels):
    """FTRL-proximal with one dictionary of coordinates, in the order that the operator takes rows."""
    rows_ = [set(toxicity.features(t).tolist()) for t in texts]
    seen = Counter(f for r in rows_ for f in r)
    l1 = max(0.5, toxicity.L1 * min(1.0, len(rows_) / toxicity.SHARD_ROWS))
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return ((l1 if z[f] > 0 else -l1) - z[f]) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows_)):
            fs = [f for f in rows_[k] if seen[f] >= toxicity.SEEN] + [2**toxicity.BITS]
            w = {f: weight(f) for f in fs}
            g = 1 / (1 + np.exp(-min(30, max(-30, sum(w.values()))))) - labels[k]
            g *= toxicity.POSITIVE_WEIGHT if labels[k] else 1
            for f in fs:
                step = ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / toxicity.ALPHA
                z[f] += g - step * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z}


def test_toxicity_weights_by_brute_force():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefghij"), 12)) for _ in range(80)]
    labels = [int("a b" in t) for t in texts]
    got, want = toxicity.train(texts, labels), brute_ftrl(texts, labels)
    assert {int(f) for f in np.flatnonzero(got)} == {f for f, w in want.items() if abs(w) > 1e-12}
    assert all(got[f] == pytest.approx(w, abs=1e-6) for f, w in want.items())


def test_toxicity_edges(spark):
    """Null, empty and very long texts, repeated rows and ids, null ids and labels."""
    table = [(None, "x y"), (1, None), (1, "b"), (1, "a"), (2, ""), (3, "word " * 200_000), (4, "v"), (4, "v")]
    docs = spark.createDataFrame([(*r, "clash") for r in table], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (4, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(table) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    none = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}


def test_every_operator_takes_dirty_rows(spark):
    """Null ids, repeated rows and ids, columns with names that the operators use."""
    texts = [None, "", " \n", "the cat and the dog went to a house of stone by the river where he was", "MIT license " * 40]
    table = [(k, t, s, *["clash"] * 9) for k in (None, None, 3, 3, 4) for t in texts for s in (None, "a")]
    df = spark.createDataFrame(table, "doc_id long, text string, source string, row string, rid string, key string, h string, at string, w string, m string, _row string, places string").repartition(3)
    n = len(table)
    for made in (
        block_naming.exact_groups(df), simhash.near_duplicates(df), suffix_dedup.remove_repeats(df), quality_rules.judge(df), license_scan.scan(df), mixing.plan(df),
        lm_scoring.score(df), quality_rules.measures(df),
    ):
        assert made.count() == n
    kept = block_naming.drop_exact_copies(df)
    assert kept.columns == df.columns and kept.count() == 3
    near = simhash.keep_representatives(df)
    assert near.columns == df.columns and near.count() == 3
    assert packing.pack_documents(df).count() == n and mixing.mixed(df).columns == df.columns and quality_rules.keep_good(df).columns == df.columns


def test_lm_scores(docs):
    got = lm_scoring.score(docs, common=20).collect()
    by_id = {r[0]: r[1] for r in rows()}
    counts = Counter()
    for r in rows():
        if crc32(str(r[0]).encode()) % 5 != 1:
            counts.update((r[1] or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = [*(by_id[r.doc_id] or "").encode().lower().split(), None]
        base = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def a_model(seed=0):
    rng = np.random.default_rng(seed)
    tree = lm_scoring.huffman(rng.integers(0, 50, lm_scoring.IDS) * (rng.random(lm_scoring.IDS) < 0.02))
    m = lm_scoring.first_model(tree)
    m["pair"] += rng.standard_normal(m["pair"].shape).astype(np.float32) * 0.3
    m["node"][:, 1:] += rng.standard_normal((lm_scoring.IDS - 1, lm_scoring.WIDTH - 1)).astype(np.float32) * 0.3
    return m, tree


def brute_text_score(m, tree, ids):
    """Window by window, id by id, in plain double arithmetic."""
    W, O, D = lm_scoring.WINDOW, lm_scoring.OVERLAP, lm_scoring.WIDTH
    d = {k: v.astype(float) for k, v in m.items()}
    ids = [int(x) for x in ids]
    read = [lm_scoring.END, *ids[:-1]]
    before = [lm_scoring.END, *read[:-1]]
    total, start = 0.0, 0
    while True:
        at = range(start, min(start + W, len(ids)))
        pairs = lm_scoring.pair_of(np.array([read[i] for i in at]), np.array([before[i] for i in at]))
        x = [d["own"][read[i]] + d["pair"][p] + d["place"][k] for k, (i, p) in enumerate(zip(at, pairs, strict=True))]
        for k, i in enumerate(at):
            if start and k < O:
                continue
            w = [np.exp((x[k] @ d["q"]) @ (x[j] @ d["k"])) for j in range(k + 1)]
            y = x[k] + sum(a * (x[j] @ d["v"]) for j, a in enumerate(w)) / sum(w)
            y = np.append(1.0, y[1:D])
            for e in range(tree.start[ids[i]], tree.start[ids[i]] + tree.length[ids[i]]):
                z = np.clip((y @ d["node"][tree.node[e]]) * tree.way[e], -20, 20)
                total -= np.log10(1 + np.exp(-z))
        if start + W >= len(ids):
            return total
        start += W - O


def test_lm_text_scores_by_brute_force():
    m, tree = a_model()
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(0, lm_scoring.END, n), lm_scoring.END) for n in (0, 1, 5, 31, 32, 55, 56, 57, 200)]
    got = lm_scoring.text_scores(m, tree, texts)
    assert got == pytest.approx([brute_text_score(m, tree, t) for t in texts], rel=1e-4)


@pytest.mark.parametrize("size", [-12.0, 12.0, 1e4])
def test_lm_scores_with_extreme_logits(size):
    """Query times key far below and above what an exponential holds."""
    m, tree = a_model()
    m["own"][:] = 0
    m["pair"][:] = 0
    m["place"][:] = 1
    m["q"][:] = np.eye(lm_scoring.WIDTH) * size
    m["k"][:] = np.eye(lm_scoring.WIDTH) * abs(size)
    text = np.append(np.arange(50), lm_scoring.END)
    [got] = lm_scoring.text_scores(m, tree, [text])
    assert np.isfinite(got) and got < 0
    trainer = lm_scoring.Trainer(m, tree)
    assert np.isfinite(trainer.learn([text[:33]])) and all(np.isfinite(v).all() for v in trainer.m.values())


def test_lm_trains_on_every_id_of_a_stretch():
    """Long words, and texts without a blank, are learned from to the end."""
    coder = lm_scoring.Subwords(open(lm_scoring.VOCABULARY, "rb").read())
    texts = ["漢字かな交じり文" * 60, " ".join("donaudampfschifffahrtsgesellschaft" * (1 + k % 4) for k in range(60)), "a b c", ""]
    for text in texts:
        words = lm_scoring.words_of(text)
        runs = [r for k in range(lm_scoring.ROUNDS) for r in lm_scoring.stretches(words, coder, k, share=1)]
        want = []
        for k in range(0, max(1, len(words)), lm_scoring.STRIDE):
            some = words[k : k + lm_scoring.READ]
            ids = coder.ids(some)
            want += list(ids if k + lm_scoring.READ >= len(words) else ids[:-1])
        trainer, seen = lm_scoring.Trainer(*a_model()), []
        decisions = lm_scoring.decisions
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lm_scoring, "decisions", lambda m, tree, h, aim: seen.extend(aim) or decisions(m, tree, h, aim))
            trainer.learn_all(runs)
        assert all(len(r) <= lm_scoring.WINDOW + 1 for r in runs)
        assert sorted(seen) == sorted(want)


def test_lm_probabilities_add_up():
    m, tree = a_model()
    h = np.random.default_rng(2).standard_normal(lm_scoring.WIDTH).astype(np.float32)
    h[0] = 1
    logs = lm_scoring.log_probabilities(m, tree, np.tile(h, (lm_scoring.IDS, 1)), np.arange(lm_scoring.IDS))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_lm_tree_gives_the_counts():
    counts = np.random.default_rng(3).integers(0, 1000, lm_scoring.IDS)
    tree = lm_scoring.huffman(counts)
    m = {k: np.zeros_like(v) for k, v in lm_scoring.first_model(tree).items()}
    m["node"][:, 0] = tree.bias
    h = np.zeros((lm_scoring.IDS, lm_scoring.WIDTH), np.float32)
    h[:, 0] = 1
    logs = lm_scoring.log_probabilities(m, tree, h, np.arange(lm_scoring.IDS))
    share = (counts + 0.05) / (counts + 0.05).sum()
    assert np.exp(logs) == pytest.approx(share, rel=1e-3, abs=1e-9)
    assert (share * tree.length).sum() < -(share * np.log2(share)).sum() + 1


def test_lm_gradients():
    """One step lowers the loss along each table by what its gradient says."""
    m, tree = a_model(5)
    batch = [np.random.default_rng(6).integers(0, 3000, 20) for _ in range(4)]
    plain = lm_scoring.Trainer(m, tree)
    taken = {}
    plain._step = lambda name, at, g, rate: taken.update({name: (at, g.copy())})
    loss = plain.learn(batch) * 4 * 19
    for name, (at, g) in taken.items():
        dense = np.zeros((len(m[name]), lm_scoring.WIDTH))
        np.add.at(dense, at, g)
        rng = np.random.default_rng(8)
        way = np.where(dense, rng.choice([-1.0, 1.0], dense.shape), 0)
        moved = {k: v.copy() for k, v in m.items()}
        eps = 2e-3
        moved[name] = (m[name] + eps * way).astype(np.float32)
        other = lm_scoring.Trainer(moved, tree)
        other._step = lambda *a: None
        up = other.learn(batch) * 4 * 19
        other.m[name] = (m[name] - eps * way).astype(np.float32)
        down = other.learn(batch) * 4 * 19
        assert (up - down) / (2 * eps) == pytest.approx((dense * way).sum(), rel=0.03, abs=0.05 * np.abs(dense).sum() ** 0.5), name
    assert loss > 0


def test_lm_beats_the_unigram_on_held_out_texts(spark):
    """Words follow one another in a fixed order, which counts of single words cannot tell."""
    rng = np.random.default_rng(11)
    cycle = ["".join(rng.choice(["ba", "ti", "ro", "len", "ka", "mu", "sho"], 3)) for _ in range(50)]
    table = []
    for k in range(1500):
        start = int(rng.integers(50))
        table.append((k, " ".join(cycle[(start + j) % 50] for j in range(40))))
    df = spark.createDataFrame(table, "doc_id long, text string").coalesce(2)
    got = [r for r in lm_scoring.score(df, share=1).collect() if r.held_out]
    base, own = sum(r.base_score for r in got), sum(r.score for r in got)
    assert len(got) > 200 and own > 0.8 * base > base


def test_lm_turns_a_text_into_ids_in_one_round_only():
    """Texts are dealt to the rounds whole, and each round has some."""
    coder = lm_scoring.Subwords(open(lm_scoring.VOCABULARY, "rb").read())
    texts = [[f"w{j}x{k}".encode() for j in range(100)] for k in range(40)]
    has = [[any(True for _ in lm_scoring.stretches(t, coder, r)) for r in range(lm_scoring.ROUNDS)] for t in texts]
    assert all(sum(x) == 1 for x in has) and all(map(any, zip(*has, strict=True)))


def test_lm_short_runs_make_steps_of_their_own():
    """A step over runs of a few ids has windows as wide as the longest of them, and no id is left out."""
    trainer, wide = lm_scoring.Trainer(*a_model()), []
    attend = lm_scoring.attend
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_scoring, "attend", lambda m, read, pair: wide.append(read.shape) or attend(m, read, pair))
        trainer.learn_all([np.arange(4 if k % 2 else 33) for k in range(10)])
    assert sorted(wide) == [(5, 3), (5, 32)]


def test_lm_learns_from_every_stretch_by_default():
    """No part of a training text is left out: each stretch has its round."""
    coder = lm_scoring.Subwords(open(lm_scoring.VOCABULARY, "rb").read())
    words = [f"word{k * k % 997}".encode() for k in range(600)]
    found = [s.tobytes() for r in range(lm_scoring.ROUNDS) for s in lm_scoring.stretches(words, coder, r)]
    every = [s.tobytes() for k in range(lm_scoring.ROUNDS) for s in lm_scoring.stretches(words, coder, k, share=1)]
    assert sorted(found) == sorted(every)


def test_lm_learns_from_every_training_text():
    coder = lm_scoring.Subwords(open(lm_scoring.VOCABULARY, "rb").read())
    for n in (0, 1, 13, 40, 400):
        words = [b"the" if k % 3 else b"of" for k in range(n)]
        found = [s for r in range(lm_scoring.ROUNDS) for s in lm_scoring.stretches(words, coder, r)]
        every = [s for r in range(lm_scoring.ROUNDS) for s in lm_scoring.stretches(words, coder, r, share=1)]
        assert found and len(every) == max(1, -(-n // lm_scoring.STRIDE))
        assert every[0][0] == lm_scoring.END or n > lm_scoring.STRIDE
    odd = ["a\u00a0b".encode(), "\u2028".encode(), b"x\x1cy", "\u00e9".encode(), b"<|endoftext|>"]
    coder.learn(odd)
    assert b"".join(coder.coder.decode_single_token_bytes(int(i)) for w in odd for i in np.frombuffer(coder[w], np.uint16)) == b" " + b" ".join(odd)


def test_empty_tables(empty, spark):
    from quillet.llm.queries import queries

    labels = spark.createDataFrame([], "doc_id long, toxic int")
    made = [
        block_naming.exact_groups(empty), block_naming.drop_exact_copies(empty), quality_rules.judge(empty), simhash.near_duplicates(empty), mixing.plan(empty), mixing.mixed(empty),
        packing.pack_documents(empty), warc.derive(warc.responses_of_pages(spark.createDataFrame([], "page_id long, url string, html string"))), suffix_dedup.remove_repeats(empty), license_scan.scan(empty), toxicity.score(empty, toxicity.fit(empty, labels)), lm_scoring.score(empty),
    ]
    assert [df.count() for df in made] == [0] * len(made) and len(queries()) == 13
