"""Token files: ids as the tokenizer gives them, exact round trips, damage found."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillet.llm import token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, n string, ids string, shard string"
MODEL = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts():
    odd = [
        None, "", " \t\n", "one", "The SAME the same. THE same?!", "don't DON'T we'll 's 'S", "a#b ## #", "x.y,z;: foo'. foo's. (bar) 12.5%", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b <|endoftext|>.",
        "á é. é  é. ̸ ≠ Å K İ ΑΣ ﬁ ǅ", "tab\x0bver\x0cform\x1cfs\x85nel\xa0nbsp ls　wide.", "漢字かな交じり文。 𝒳𝒴 🙂🙂.", "\x00 zero \x7f", "mixed123abc. 1234 ½ ²", "word " * 20000, "deux mots. " * 7 + "ende,",
    ]
    rng = np.random.default_rng(1)
    for k in range(60):
        odd.append(" ".join("".join(rng.choice(list("abcdeéßÀÉ.,'!\n"), int(rng.integers(1, 9)))) for _ in range(int(rng.integers(1, 200)))))
    return odd


def rows():
    out = [(3 * k, t) for k, t in enumerate(texts())]
    return [*out, (9, "repeat of nine"), (9, "one"), (9, "one"), (None, "no id"), (None, None), (-5, "below zero")]


def brute(table):
    """The contract, one document at a time; of equal doc_ids the shorter ones first, so starts of ties are compared as sets."""
    out = []
    for doc_id, text in table:
        ids = np.array([*MODEL.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    return Counter(out)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", 0, "x", "y", "z", "w") for d, t in rows()], SCHEMA).repartition(3)


def test_words_give_the_ids_of_whole_texts():
    words = token_files.Words(open(public_tokenizers.path("word_bpe_49k.json")).read())
    given = [t or "" for t in texts()]
    for _ in range(2):  # looked up, then remembered
        got = words.texts(pa.array(given))
        assert [list(x) for x in got] == [e.ids for e in MODEL.encode_batch(given, add_special_tokens=False)]
    assert [list(x) for x in words.texts(pa.array(["left out", *given]).slice(1))] == [list(x) for x in got]


def test_words_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    words = token_files.Words(open(public_tokenizers.path("word_bpe_49k.json")).read())
    for t in texts():
        assert list(words.texts(pa.array([t or ""]))[0]) == MODEL.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block,shard", [(token_files.BLOCK, token_files.SHARD), (777, 3000)])
def test_documents_by_brute_force(spark, docs, tmp_path, block, shard):
    folder = f"file://{tmp_path}/files"
    token_files.write(docs, folder, block=block, shard=shard)
    got = token_files.read_documents(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == brute(rows())
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    known = [r.doc_id for r in got]
    assert known == [None, None, *sorted(d for d in known if d is not None)]
    total = spark.read.parquet(f"{folder}/table").selectExpr("sum(frequency)", "min(frequency)").first()
    assert total[0] & (total[0] - 1) == 0 and total[1] >= 1
    some = {r.doc_id: list(r.ids) for r in token_files.read_ids(spark, folder, 30, 60).collect()}
    assert some == {d: [*MODEL.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows() if d is not None and 30 <= d <= 60}


def test_damage_is_found(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/files"
    token_files.write(docs, folder, block=5000)
    blocks = spark.read.parquet(f"{folder}/blocks")
    blocks.selectExpr("* except (words)", "if(block = 1, concat(x'00', substr(words, 2)), words) AS words").write.parquet(f"{tmp_path}/bad/blocks")
    for name in ("table", "shards"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{tmp_path}/bad/{name}")
    with pytest.raises(Exception, match="block 1: the words are damaged"):
        token_files.read_documents(spark, f"{tmp_path}/bad").collect()
    blocks.filter("block <> 1").write.parquet(f"{tmp_path}/lost/blocks")
    for name in ("table", "shards"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{tmp_path}/lost/{name}")
    with pytest.raises(Exception, match="lacks a block"):
        token_files.read_documents(spark, f"{tmp_path}/lost").collect()


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 4096, 50_000])
@pytest.mark.parametrize("kinds", [1, 2, 40_000])
def test_round_trip_from_every_checkpoint(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = np.minimum(rng.zipf(1.3, n), kinds).astype(np.uint32) if kinds > 2 else rng.integers(0, kinds, n).astype(np.uint32)
    known, count = np.unique(np.append(ids, np.arange(kinds, dtype=np.uint32)), return_counts=True)
    freq, bits = token_files.frequencies(count)
    assert freq.sum() == 1 << bits and freq.min() >= 1
    table = token_files.make_table(known, freq)
    lanes, words, marks = token_files.encode(ids, table, every=4000, lane=16, most=64)
    stream = words.astype(np.uint64)
    assert np.array_equal(token_files.decode(stream, n, lanes, marks, table)[1], ids)
    for m in marks:
        first, part = token_files.decode(stream, n, lanes, marks, table, m["at"] + 3, min(n, m["at"] + 90))
        assert first == m["at"] or m["at"] + 3 >= first
        assert np.array_equal(part, ids[first : min(n, m["at"] + 90)])
    if kinds > 2 and n > 10_000:  # near the entropy
        p = count / count.sum()
        ideal = -np.log2(p[np.searchsorted(known, ids)]).sum() / 8
        assert 4 * len(words) < 1.02 * ideal + 8 * lanes


def test_crc_of_pieces():
    data = np.random.default_rng(0).bytes(1000)
    for cuts in ([0, 1000], [0, 1, 1000], [0, 333, 334, 900, 1000]):
        total = 0
        for i, j in zip(cuts, cuts[1:]):
            total ^= token_files.shifted_crc(zlib.crc32(data[i:j]), 1000 - j)
        assert total == zlib.crc32(data)


def test_unknown_ids_and_empty_table(spark, tmp_path):
    with pytest.raises(ValueError):
        token_files.encode(np.array([7], np.uint32), token_files.make_table(np.array([1, 2]), np.array([2048, 2048])))
    assert token_files.encoded_documents(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none").count() == 0


def test_words_are_encoded_a_bounded_number_at_once():
    """Many new words give what each gives alone, without one call for all of them."""
    words = token_files.Words(Path(public_tokenizers.path(token_files.TOKENIZER)).read_text())
    encode, asked = words.encode, []
    words.encode = lambda batch, **k: asked.append(sum(t.count(" ") + 1 for t in batch)) or encode(batch, **k)
    new = [f"w{'abcdefghij'[k % 10]}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k % 26)}{'x' * (k % 5)}" for k in range(40_000)] + [f"{k}-a" for k in range(20_000)]
    new = list(dict.fromkeys(new))
    at = words.places(new)
    assert max(asked) <= 16_384 < len(new)
    for k in range(0, len(new), 997):
        i = at[k]
        assert words.flat[words.starts[i] : words.starts[i] + words.lens[i]].tolist() == encode([new[k]], add_special_tokens=False)[0].ids
