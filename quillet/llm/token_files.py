"""Token ids in binary files: a static range asymmetric numeral system over interleaved lanes (operator 11).

Whole texts become ids of a public tokenizer; each document ends with one id
more.  A first pass over all documents counts the ids; the counts become one
shared frequency table that sums to a power of two.  Documents are then dealt by
ranges of doc_id, and each range is a shard: its ids, one document after the other,
are cut into blocks that are encoded apart.

Inside a block, id ``i`` belongs to lane ``i % lanes``.  All lanes take a step at a
time, as numpy vectors, and give off 32-bit words into one stream, in order of
lanes, so that the decoder reads it forwards.  States are 64-bit.  A block carries a checkpoint (states and place
in the stream) every so many ids, at which decoding may begin, and CRC-32 sums of its
words and of its ids.  Blocks are decoded in any order on any task.

A folder of files holds three Parquet tables, written by Spark and readable wherever
Spark's own tables are:

* ``table``: id, frequency;
* ``blocks``: shard, block, first (ids of the shard before it), n, lanes, first_doc, last_doc, words,
  words_crc32, ids_crc32, checkpoints (at, word, states) and docs (ord, doc_id, at, n, total), the
  documents that the block holds ids of, ``at`` ids from their start;
* ``shards``: shard, start (ids of all shards before it), n, documents.

A document over several blocks gets its CRC from those of its pieces: a piece's CRC,
shifted by the bytes that follow it, adds up by exclusive or, so pieces meet in an
ordinary aggregate.

Words between blanks are looked up once per batch: ``ascii_split_whitespace`` and a
dictionary of the batch, then a bounded cache of the worker, then the tokenizer.  The tokenizer drops white space and
never joins across it, so this gives the ids of the whole text; letters and digits followed by
plain punctuation are looked up apart, in lower case, as its rules part them there.

Edge cases: a null text is empty and has the end id alone; a null doc_id comes first; rows of one doc_id
are documents of their own, in order of length and hash; an empty table gives
tables without rows; extra columns are ignored.  A damaged block raises an error that names it.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import delete_folder, session, shared_folder

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Ids of a block, between two checkpoints, and (about) of a shard; ids that a lane has at least; most lanes.
BLOCK, CHECKPOINT, SHARD, LANE, LANES = 1 << 18, 1 << 16, 1 << 24, 256, 1024
#: Words a worker remembers; bytes of text that it takes at once; words that it encodes at once.
REMEMBERED, SLICE, AT_ONCE = 600_000, 4 << 20, 16_384
_LOW = np.uint64(1 << 31)
_PUNCTUATION = ".,;:!?%*#$&)"

_TOKENS = "rid long, doc_id long, n long, ids binary"
_BLOCKS = (
    "shard int, block int, first long, n int, lanes int, first_doc long, last_doc long, words binary, words_crc32 long, ids_crc32 long,"
    " checkpoints array<struct<at: int, word: int, states: binary>>, docs array<struct<ord: long, doc_id: long, at: long, n: long, total: long>>"
)


# ---- texts to ids ----


def _take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` one after the other, and where each ends."""
    n = lens[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[which] - (ends - n), n)], ends


class Words:
    """Ids of words by way of a bounded cache: when it is full, words that were met once are forgotten."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_str(tokenizer).encode_batch_fast
        #: Which ids close a word, where the vocabulary says so.
        suffix, vocabulary = json.loads(tokenizer)["model"].get("end_of_word_suffix"), json.loads(tokenizer)["model"]["vocab"]
        self.closes = np.zeros(max(vocabulary.values()) + 2, bool)
        if suffix:
            self.closes[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.known: dict[str, int] = {}
        self.used, self.flat, self.starts, self.lens, self.met = 0, np.zeros(1 << 16, np.uint32), *(np.zeros(1 << 14, np.int64) for _ in range(3))

    def _encode(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the words, one after the other, and how many each has; in parts of ``AT_ONCE`` words, as the tokenizer's own results are large."""
        out = []
        for k in range(0, max(1, len(words)), AT_ONCE):
            ids = [e.ids for e in self.encode(words[k : k + AT_ONCE], add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            out.append((np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens))
        return out

    def _encode_joined(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``_encode`` but in parts, for words of letters, which close once as a rule: joined by blanks and parted where an id closes a word.

        Each word closes at least once, so where there are as many closing ids as words, each closes
        once; other groups are encoded word by word.
        """
        out = []
        for begin in range(0, len(words), AT_ONCE):
            groups = [words[k : min(k + 64, begin + AT_ONCE)] for k in range(begin, min(len(words), begin + AT_ONCE), 64)]
            for group, e in zip(groups, self.encode([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.closes[np.minimum(ids, len(self.closes) - 1)]) + 1
                out += [(ids, np.diff(ends, prepend=0))] if len(ends) == len(group) and ends[-1] == len(ids) else self._encode(group)
        return out

    def _forget(self, room: int) -> None:
        """Keep the words met most often, ``REMEMBERED`` / 2 at most and none if ``room`` is more than is left then."""
        least = 2
        while np.count_nonzero(self.met[: len(self.known)] >= least) > REMEMBERED // 2:
            least += 1
        stay = self.met[: len(self.known)] >= least if room <= REMEMBERED // 2 else np.zeros(len(self.known), bool)
        at = np.flatnonzero(stay)
        flat, ends = _take(self.flat, self.starts, self.lens, at)
        self.known = {w: k for k, w in enumerate(w for w, s in zip(self.known, stay) if s)}
        self.lens[: len(at)], self.met[: len(at)] = self.lens[at], 1
        self.starts[: len(at)] = ends - self.lens[: len(at)]
        self.flat[: len(flat)], self.used = flat, len(flat)

    def places(self, words: list[str]) -> np.ndarray:
        """Numbers of the (different) words in starts and lens."""
        if len(self.known) + len(words) > REMEMBERED and self.known:
            self._forget(len(words))
        new = [w for w in words if w not in self.known]
        if new:
            letters = [w for w in new if w.isalpha()]
            others = [w for w in new if not w.isalpha()]
            ids = self._encode(others) + self._encode_joined(letters)
            flat, lens = (np.concatenate(x) for x in zip(*ids, strict=True))
            n, m = len(self.known), self.used
            grow = lambda x, need: x if need <= len(x) else np.concatenate([x, np.zeros(need, x.dtype)])
            self.flat, self.starts, self.lens, self.met = grow(self.flat, m + len(flat)), *(grow(x, n + len(new)) for x in (self.starts, self.lens, self.met))
            self.flat[m : m + len(flat)], self.lens[n : n + len(new)], self.met[n : n + len(new)] = flat, lens, 0
            self.starts[n : n + len(new)] = m + np.cumsum(lens) - lens
            self.used = m + len(flat)
            self.known.update(zip(others + letters, range(n, n + len(new))))
        out = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.met[out] += 1
        return out

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        lists = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(lists.flatten())
        words = coded.dictionary
        parts = pc.extract_regex(words, rf"^(?P<stem>[\p{{L}}\p{{N}}]+)(?P<tail>[{_PUNCTUATION}]*)$")
        plain = pc.is_valid(parts)
        stems = pc.dictionary_encode(pc.if_else(plain, pc.ascii_lower(pc.struct_field(parts, "stem")), words))
        tails = pc.dictionary_encode(pc.if_else(plain, pc.struct_field(parts, "tail"), ""))
        pieces = pa.concat_arrays([stems.dictionary, tails.dictionary]).dictionary_encode()  # so that all are looked up at once
        places = self.places(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        both = np.stack([places[stems.indices.to_numpy()], places[len(stems.dictionary) :][tails.indices.to_numpy()]], 1).ravel()
        flat, ends = _take(self.flat, self.starts, self.lens, both)
        ends = ends[1::2]
        lens = np.diff(ends, prepend=0)
        out, ends = _take(flat, ends - lens, lens, coded.indices.to_numpy())
        ends = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [out[i:j] for i, j in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=1)
def _words(tokenizer: str) -> Words:
    return Words(tokenizer)


def _slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Runs of texts of about ``limit`` bytes, one text at least."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + limit, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """(rid, doc_id, n, ids): the ids of each whole text and the end id, compressed."""
    spark = session(docs)
    model: Broadcast = spark.sparkContext.broadcast(Path(public_tokenizers.path(tokenizer)).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squeeze = _words(model.value), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            done = 0
            for texts in _slices(batch["text"], SLICE):
                ids = [np.append(x, np.uint32(end)) for x in words.texts(texts)]
                rows = batch.slice(done, len(ids))
                done += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [rows["rid"], rows["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([_squeezed(x, squeeze) for x in ids], pa.binary())],
                    ["rid", "doc_id", "n", "ids"],
                )

    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(run, _TOKENS)


def _squeezed(ids: np.ndarray, squeeze: Callable[[bytes], bytes]) -> bytes:
    """Ids as compressed little-endian integers of 2 bytes, or 4 where one needs them, after a byte that says which."""
    size = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([size]) + squeeze(ids.astype(f"<u{size}").tobytes())


def _opened_ids(data: bytes, open_: Callable[[bytes], bytes]) -> np.ndarray:
    return np.frombuffer(open_(data[1:]), f"<u{data[0]}")


# ---- the shared table ----


def counts(tokens: DataFrame) -> DataFrame:
    """(id, count) over all documents: one row per id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, open_ = np.zeros(0, np.int64), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                own = np.bincount(np.concatenate([_opened_ids(x, open_) for x in batch["ids"].slice(begin, 256).to_pylist()]))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "count"])

    return tokens.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def frequencies(count: np.ndarray) -> tuple[np.ndarray, int]:
    """Whole frequencies of one at least that sum to a power of two, in proportion to ``count``, and its exponent."""
    if not len(count):
        return np.zeros(0, np.int64), 12
    bits = max(12, int(len(count) - 1).bit_length() + 2)
    share = np.maximum(1, count.astype(object) * (1 << bits) // int(count.sum())).astype(np.int64)
    left = (1 << bits) - int(share.sum())
    while left:  # the most frequent give and get
        at = int(share.argmax())
        change = left if left > 0 else -min(-left, int(share[at]) // 2)
        share[at] += change
        left -= change
    return share, bits


class Table(NamedTuple):
    """Ids in order, their frequencies and first slots, the id number of each slot, the number of each id (-1: none), and the exponent of the sum."""

    ids: np.ndarray
    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray
    number: np.ndarray
    bits: int


def make_table(ids: np.ndarray, freq: np.ndarray) -> Table:
    freq = freq.astype(np.uint64)
    number = np.full(int(ids.max(initial=0)) + 2, -1, np.int64)
    number[ids] = np.arange(len(ids))
    return Table(ids.astype(np.uint32), freq, (np.cumsum(freq) - freq).astype(np.uint64), np.repeat(np.arange(len(ids), dtype=np.uint32), freq.astype(np.int64)), number, max(1, int(freq.sum())).bit_length() - 1)


# ---- blocks ----


def encode(ids: np.ndarray, table: Table, every: int = CHECKPOINT, lane: int = LANE, most: int = LANES) -> tuple[int, np.ndarray, list[dict]]:
    """(lanes, words, checkpoints) of one block; ids outside the table raise ValueError."""
    which = table.number[np.minimum(ids, len(table.number) - 1)]
    if len(ids) and which.min() < 0:
        raise ValueError("an id is not in the table")
    lanes = int(min(most, max(1, -(-len(ids) // lane))))
    freq, start = table.freq[which], table.start[which]
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks, given = [], 0
    bits, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    steps, gap = -(-len(ids) // lanes), max(1, every // lanes)
    for step in range(steps - 1, -1, -1):
        f, b = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        own = x[: len(f)]  # the last step may fill the first lanes only
        full = own >= f << room
        if full.any():
            words.append((own[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            given += len(words[-1])
            own[full] >>= np.uint64(32)
        q = own // f
        own[:] = (q << bits) + (own - q * f) + b
        if step % gap == 0:
            marks.append((step * lanes, given, x.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return lanes, stream, [{"at": at, "word": given - n, "states": states} for at, n, states in reversed(marks)]


def decode(stream: np.ndarray, n: int, lanes: int, checkpoints: list[dict], table: Table, begin: int = 0, end: int | None = None) -> tuple[int, np.ndarray]:
    """(first, ids): the ids of a block from the last checkpoint at or before ``begin`` to ``end``."""
    end = n if end is None else end
    if not n:
        return 0, np.zeros(0, np.uint32)
    mark = max((c for c in checkpoints if c["at"] <= begin), key=lambda c: c["at"])
    x, at, word = np.frombuffer(mark["states"], "<u8").astype(np.uint64), mark["at"], mark["word"]
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = []
    while at < end:
        own = x[: min(lanes, n - at)]
        slot = own & mask
        which = table.slot[slot.astype(np.int64)]
        out.append(which)
        own[:] = table.freq[which] * (own >> bits) + slot - table.start[which]
        low = own < _LOW
        k = int(np.count_nonzero(low))
        if k:
            own[low] = (own[low] << np.uint64(32)) | stream[word : word + k]
            word += k
        at += len(own)
    return mark["at"], table.ids[np.concatenate(out)][: end - mark["at"]] if out else np.zeros(0, np.uint32)


# ---- files ----


def _blocks(table: Broadcast, block: int):
    """One shard (a sorted partition) as blocks of ``block`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        held: list[np.ndarray] = []
        docs: list[dict] = []
        size = ordinal = number = first = shard = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs, size, number, first
            ids = np.concatenate(held)
            lanes, words, checkpoints = encode(ids, table.value)
            data, known = words.tobytes(), [d["doc_id"] for d in docs if d["doc_id"] is not None]
            row = {
                "shard": shard, "block": number, "first": first, "n": len(ids), "lanes": lanes, "first_doc": min(known, default=None), "last_doc": max(known, default=None),
                "words": data, "words_crc32": zlib.crc32(data), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "checkpoints": checkpoints, "docs": docs,
            }
            number, first, held, docs, size = number + 1, first + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for s, doc_id, n, data in zip(batch["shard"].to_pylist(), batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["ids"]):
                ids, at, shard = _opened_ids(data.as_py(), open_), 0, s
                while at < n:
                    take = min(n - at, block - size)
                    held.append(ids[at : at + take])
                    docs.append({"ord": ordinal, "doc_id": doc_id, "at": at, "n": take, "total": n})
                    size, at = size + take, at + take
                    if size == block:
                        yield flush()
                ordinal += 1
        if size:
            yield flush()

    return run


_MARK = pa.struct([("at", pa.int32()), ("word", pa.int32()), ("states", pa.binary())])
_DOC = pa.struct([("ord", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("total", pa.int64())])
_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("lanes", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
        ("words", pa.binary()), ("words_crc32", pa.int64()), ("ids_crc32", pa.int64()), ("checkpoints", pa.list_(_MARK)), ("docs", pa.list_(_DOC)),
    ]
)


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end: int = END, block: int = BLOCK, shard: int = SHARD) -> None:
    """Write the files of ``docs`` to ``folder``, in ascending order of doc_id."""
    spark = session(docs)
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_ids(docs, tokenizer, end).write.parquet(path)
    tokens = spark.read.schema(_TOKENS).parquet(path)
    found = counts(tokens).orderBy("id").collect()  # one row per id of the vocabulary
    ids, count = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
    freq, _ = frequencies(count)
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freq)], "id long, frequency long").coalesce(1).write.parquet(f"{folder}/table")
    table = spark.sparkContext.broadcast(make_table(ids, freq))
    parts = max(1, -(-int(count.sum()) // shard))
    order = ["doc_id", "n", F.xxhash64("ids"), "rid"]
    dealt = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select(F.spark_partition_id().alias("shard"), "doc_id", "n", "ids").mapInArrow(_blocks(table, block), _BLOCKS).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    own = blocks.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.expr("size(filter(docs, d -> d.at = 0))")).alias("documents"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    own.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n", "documents").coalesce(1).write.parquet(f"{folder}/shards")
    table.destroy()
    delete_folder(spark, path)


def _table_of(spark: SparkSession, folder: str) -> Broadcast:
    found = spark.read.parquet(f"{folder}/table").orderBy("id").collect()  # one row per id of the vocabulary
    return spark.sparkContext.broadcast(make_table(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)))


def _opened(row: dict, table: Table, begin: int = 0, end: int | None = None) -> tuple[int, np.ndarray]:
    """The checked ids of a block; only a whole block has its ids' sum checked."""
    where = f"shard {row['shard']}, block {row['block']}"
    if zlib.crc32(row["words"]) != row["words_crc32"]:
        raise ValueError(f"{where}: the words are damaged")
    first, ids = decode(np.frombuffer(row["words"], "<u4").astype(np.uint64), row["n"], row["lanes"], row["checkpoints"], table, begin, end)
    if len(ids) == row["n"] and zlib.crc32(ids.astype("<u4").tobytes()) != row["ids_crc32"]:
        raise ValueError(f"{where}: the ids are damaged")
    return first, ids


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), bits reflected, modulo that of CRC-32."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
        b = (b << 1) & 0xFFFFFFFF
    return out


def shifted_crc(crc: int, after: int) -> int:
    """What a piece with this CRC-32 adds, by exclusive or, to the CRC of a text where ``after`` bytes follow it."""
    power, square = 0x80000000, 0x00800000  # 1 and x^8
    while after:
        if after & 1:
            power = _times(power, square)
        square = _times(square, square)
        after >>= 1
    return _times(crc, power)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, all of whose blocks are decoded and checked."""
    table = _table_of(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, ids = _opened(row, table.value)
                data, at, out = memoryview(ids.astype("<u4").tobytes()), 0, []
                for d in row["docs"]:
                    after = 4 * (d["total"] - d["at"] - d["n"])
                    crc = zlib.crc32(data[4 * at : 4 * (at + d["n"])])
                    out.append((row["shard"], d["ord"], d["doc_id"], row["first"] + at - d["at"], d["n"], d["total"], shifted_crc(crc, after) if after else crc))
                    at += d["n"]
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "ord", "doc_id", "at", "n", "total", "crc"])

    blocks = spark.read.parquet(f"{folder}/blocks").drop("first_doc", "last_doc")
    pieces = blocks.mapInArrow(run, "shard long, ord long, doc_id long, at long, n long, total long, crc long")
    whole = pieces.groupBy("shard", "ord", "doc_id", "at", "total").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("crc"))
    checked = F.when(F.col("n") == F.col("total"), F.col("total")).otherwise(F.raise_error(F.lit("a document lacks a block")).cast("long"))
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "start")
    return whole.join(shards, "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), checked.alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """(doc_id, ids) of the documents from ``low`` to ``high``: only blocks that hold some are read, each from the last checkpoint before them."""
    table = _table_of(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum([d["n"] for d in row["docs"]])
                mine = [i for i, d in enumerate(row["docs"]) if d["doc_id"] is not None and low <= d["doc_id"] <= high]
                begin, end = int(ends[mine[0]]) - row["docs"][mine[0]]["n"], int(ends[mine[-1]])
                first, ids = _opened(row, table.value, begin, end)
                out = [{"shard": row["shard"], "part": {k: row["docs"][i][k] for k in ("ord", "doc_id", "at")} | {"ids": ids[ends[i] - row["docs"][i]["n"] - first : ends[i] - first].tolist()}} for i in mine]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("shard", pa.int32()), ("part", pa.struct([("ord", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(pa.int64()))]))]))

    blocks = spark.read.parquet(f"{folder}/blocks").filter((F.col("first_doc") <= high) & (F.col("last_doc") >= low))
    blocks = blocks.filter(F.exists("docs", lambda d: d["doc_id"].between(low, high)))
    parts = blocks.mapInArrow(run, "shard int, part struct<ord: long, doc_id: long, at: long, ids: array<long>>").select("shard", "part.*")
    whole = parts.groupBy("shard", "ord", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))  # the blocks of one document
    return whole.select("doc_id", F.flatten("parts.ids").alias("ids"))


def encoded_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to files (in the shared folder unless one is named) and read them back."""
    folder = folder or f"{shared_folder(session(docs))}/token-files-{uuid.uuid4().hex}"
    write(docs, folder)
    return read_documents(session(docs), folder)
