"""Language-model scoring by a causal self-attention model (operator 9).

Words are turned into subword ids by a public tokenizer's vocabulary (its path
is a parameter; the tokenizer is never trained).  The model reads embeddings of
an id, of its pair with the id before (hashed to ``PAIRS`` rows) and of its place,
adds one layer of masked self-attention, and gives the next id a probability by
a tree of binary decisions (a Huffman tree over the corpus's id counts), each a
logistic unit over the layer's output.  So all ids have a context-dependent
probability at the price of a path, and the probabilities add up to one.  A text
is scored in overlapping windows of ``WINDOW`` ids: each window reads the last
``OVERLAP`` ids of the one before as context and scores the others, so each id is
scored once; all windows of a batch go through the layer together.

Learning: everything is numpy inside Spark tasks.  Each task trains on the
training documents of its partition (AdaGrad, one vector of squared gradients per
row) from every stretch of words of every training document, each text in one of ``ROUNDS``
rounds; ``share`` can name a sparser choice.  A stretch of more
ids than a window is learned from in further windows, to its last id.  A task gives
the change of the rows that it touched; Spark averages the changes row by row,
and each round starts from the average before.  The model has a fixed size
(``ROWS`` rows of ``WIDTH`` numbers), whatever the corpus.  The tree and its first
biases come from counts over all training documents.

Scale: word counts are combined before the shuffle and written as a table in
the shared folder.  The ``COMMON`` most frequent words (a fixed bound) travel to
the tasks as a dictionary; all other words are joined with the table by word,
one row per document and distinct word, so nothing that grows is broadcast.

Edge cases: a null or empty text is one end token; a null doc_id is training
data; repeated rows are counted and scored one by one; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END, IDS = 50256, 50257
WIDTH, WINDOW, OVERLAP = 16, 32, 8
PAIRS = 1 << 16
#: Training: one stretch of words in SHARE (1: all), in so many rounds; windows a step; learning rate.
SHARE, ROUNDS, BATCH, RATE = 1, 2, 64, 0.2
#: Words from one stretch to the next, and words read from each.
STRIDE, READ = 12, 14
#: A run of so many ids is a short one.
FEW = 8
COMMON = 200_000
_CACHE = 400_000
_GAP = b" "
#: The rows of the model: ids, pairs, tree nodes, places, and the three maps of the attention layer.
_SIZES = {"own": IDS, "pair": PAIRS, "node": IDS - 1, "place": WINDOW, "q": WIDTH, "k": WIDTH, "v": WIDTH}
ROWS = sum(_SIZES.values())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, runs of ``[^\\x20\\x09-\\x0D]``."""
    return (text or "").encode().lower().split()


class Subwords(dict):
    """Word to its ids, as the bytes of 16-bit numbers; forgets when full."""

    def __init__(self, vocabulary: bytes) -> None:
        """``vocabulary``: what is in the vocabulary's file."""
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        # The pattern keeps a word, which has no blank, whole with the blank before it.
        self.coder = tiktoken.Encoding("subwords", pat_str=r" ?[^ ]+| +", mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(IDS, bool)
        self.opens[[i for piece, i in ranks.items() if piece.startswith(_GAP)]] = True

    def learn(self, words: Iterable[bytes]) -> None:
        """Ids for words that are not known yet, all in one call."""
        new = [w for w in words if w not in self]
        if new:
            if len(self) + len(new) > _CACHE:
                self.clear()
            ids = np.array(self.coder.encode_ordinary((_GAP + _GAP.join(new)).decode()), np.uint16)
            edges = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            data = ids.tobytes()
            self.update(zip(new, (data[2 * i : 2 * j] for i, j in zip(edges, edges[1:], strict=False)), strict=True))

    def __missing__(self, word: bytes) -> bytes:
        self.learn([word])
        return self[word]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of a text and its end."""
        return np.append(np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint16), np.uint16(END))

    def texts(self, words: list[bytes], places: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of texts and their ends: ``places`` are numbers of different ``words``, up to ``ends`` for each text."""
        self.learn(words)
        own = [self[w] for w in words]
        flat = np.frombuffer(b"".join(own), np.uint16)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 2
        first = np.cumsum(size) - size
        n = size[places]
        stop = np.cumsum(n)
        out = flat[np.arange(int(n.sum())) + np.repeat(first[places] - (stop - n), n)]
        cuts = np.concatenate(([0], np.concatenate(([0], stop))[ends]))
        return [np.append(out[i:j], np.uint16(END)) for i, j in zip(cuts, cuts[1:], strict=False)]


_COUNTS = "word string, n long"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of some texts, the number of each place's word among them, and where each text ends; as ``words_of``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # blanks at either end leave an empty word
    coded = pc.dictionary_encode(flat.filter(pa.array(there)))
    return coded.dictionary, coded.indices.to_numpy(), np.concatenate(([0], np.cumsum(there)))[ends]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            words, places, _ = split_words(batch["text"].slice(k, 1000))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(places, minlength=len(words)), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents, as a table in the shared folder."""
    training = docs.filter(~held_out(F.col("doc_id"))).select("text")
    return written(training.mapInArrow(_count_words, _COUNTS).groupBy("word").agg(F.sum("n").alias("c")), "words")


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary's file (a fixed size), read by the driver and shipped with the job."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def id_counts(counts: DataFrame, vocabulary: Broadcast) -> np.ndarray:
    """How often each id occurs in the training documents, without the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = Subwords(vocabulary.value), np.zeros(IDS)
        for batch in batches:
            words, c = batch["word"].cast(pa.binary()).to_pylist(), batch["c"].to_numpy()
            coder.learn(words)
            ids = [coder[w] for w in words]
            total += np.bincount(np.frombuffer(b"".join(ids), np.uint16), np.repeat(c, [len(x) // 2 for x in ids]), IDS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = counts.mapInArrow(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most IDS rows
    out = np.zeros(IDS)
    out[found.id.to_numpy()] = found.n.to_numpy()
    return out


#: Nodes whose logits are taken for all outputs at once by a matrix product; they are the most frequent of the tree.
TOP = 128


class Tree(NamedTuple):
    """The path of each id: nodes ``node[start[i]:start[i] + length[i]]`` and the way taken at each, 1 or -1.

    Nodes are numbered as they were made, so the last ``TOP`` are the most frequent ones.
    """

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    way: np.ndarray
    bias: np.ndarray


def huffman(counts: np.ndarray) -> Tree:
    """A Huffman tree over ids, with the log odds of each node's two sides."""
    n = len(counts)
    weight = np.concatenate((counts + 0.05, np.zeros(n - 1)))
    heap = [(w, i) for i, w in enumerate(weight[:n].tolist())]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64)
    for new in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = new
        side[j] = 1
        weight[new] = a + b
        heapq.heappush(heap, (a + b, new))
    root = 2 * n - 2
    one = np.zeros(n - 1)
    one[parent[:root][side[:root] == 1] - n] = weight[:root][side[:root] == 1]
    at, found = np.arange(n), []  # all ids climb together
    ids = np.arange(n)
    while len(ids):
        found.append((ids, parent[at] - n, side[at] * 2 - 1))
        at = parent[at]
        ids, at = ids[at != root], at[at != root]
    ids, node, way = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.argsort(ids, kind="stable")
    length = np.bincount(ids, minlength=n)
    return Tree(np.cumsum(length) - length, length, node[by], way[by].astype(np.float32), np.log(one / (weight[n:] - one)).astype(np.float32))


Model = dict[str, np.ndarray]


def parts(rows: np.ndarray) -> Model:
    """The tables of a model from its rows."""
    edges = np.cumsum([0, *_SIZES.values()])
    return {name: rows[a:b].copy() for name, a, b in zip(_SIZES, edges, edges[1:], strict=False)}


def whole(m: Model) -> np.ndarray:
    return np.concatenate([m[name] for name in _SIZES])


def first_model(tree: Tree, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    spread = {"own": 0.3, "pair": 0.0, "node": 0.05, "place": 0.1, "q": 0.3, "k": 0.3, "v": 0.1}
    m = {name: (rng.standard_normal((n, WIDTH)) * spread[name]).astype(np.float32) for name, n in _SIZES.items()}
    m["node"][:, 0] = tree.bias  # an output's first number is 1
    return m


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return table.take(at, 0, mode="clip")


def pair_of(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    mixed = now.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + before.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed * np.uint64(0x165667B19E3779F9) >> np.uint64(48)).astype(np.int64) & (PAIRS - 1)


_SEES = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Added to the logits of the places that a place must not see.
_HIDDEN = np.triu(np.full((WINDOW, WINDOW), -1e30, np.float32), 1)
#: Up to this logit exponentials are taken as they are; from this sum on they stand for their place.
_PLAIN, _ENOUGH = 60.0, 1e-25
_WIDE_ONES = np.ones(WIDTH, np.float32)


def attend(m: Model, read: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, ...]:
    """Masked attention over windows: inputs, queries, keys, values, unscaled weights, their sums and outputs.

    The first number of an output is 1, so that a node's first number is its bias.
    Where an exponential could overflow, or those of all visible places vanish, the largest visible logit of each
    place is taken off first; the weights' shares are the same.
    """
    shape = (*read.shape, WIDTH)
    wide = read.shape[1]  # WINDOW at most
    x = (_rows(m["own"], read.ravel()) + _rows(m["pair"], pair.ravel())).reshape(shape) + m["place"][:wide]
    q, k, v = np.split((x.reshape(-1, WIDTH) @ np.concatenate((m["q"], m["k"], m["v"]), 1)).reshape(*read.shape, -1), 3, 2)
    v[..., 0] = 1  # the first number of an output is 1 whatever is seen, so the sum of the weights comes in its place
    a = q @ k.transpose(0, 2, 1)
    plain = a.max(initial=0) < _PLAIN
    if plain:
        np.exp(a, out=a)
        a *= _SEES[:wide, :wide]
        seen = a @ v
        plain = seen[..., 0].min(initial=1) > _ENOUGH
    if not plain:
        a = q @ k.transpose(0, 2, 1) + _HIDDEN[:wide, :wide]
        a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        seen = a @ v
    total = seen[..., :1].copy()
    y = x + seen / total
    y[..., 0] = 1
    return x, q, k, v, a, total, y


class Decisions(NamedTuple):
    """The paths of some aims: nodes, ways and logits, the first of each path, and which aim each is of.

    ``cell`` is the place of a frequent node in the matrix of outputs and ``TOP`` nodes; ``tail`` are the other
    decisions, with their node rows in ``units``.
    """

    node: np.ndarray
    way: np.ndarray
    z: np.ndarray
    first: np.ndarray
    of: np.ndarray
    cell: np.ndarray
    tail: np.ndarray
    units: np.ndarray


def decisions(m: Model, tree: Tree, h: np.ndarray, aim: np.ndarray) -> Decisions:
    """The path of each aim below its output."""
    length = tree.length.take(aim)
    first = np.cumsum(length) - length
    of = np.repeat(np.arange(len(aim)), length)
    at = np.arange(len(of)) + (tree.start.take(aim) - first).take(of)
    node, way = tree.node.take(at), tree.way.take(at)
    low = len(m["node"]) - TOP
    tail = np.flatnonzero(node < low)
    cell = of * TOP + (node - low)
    z = (h @ m["node"][low:].T).ravel().take(cell, mode="clip")
    units = _rows(m["node"], node[tail])
    z[tail] = (h.take(of[tail], 0) * units) @ _WIDE_ONES
    z *= way
    return Decisions(node, way, np.clip(z, -20, 20, out=z), first, of, cell, tail, units)


def log_probabilities(m: Model, tree: Tree, h: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """The log of the probability of each aim, given the output that reads up to it."""
    d = decisions(m, tree, h, aim)
    # Logits are bounded, so a path's product stays in range; one logarithm serves the path.
    z = np.negative(d.z, out=d.z)
    return -np.log(np.multiply.reduceat(1 + np.exp(z, out=z), d.first, dtype=np.float64))


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places read by each window (as many as WINDOW), and which of them it scores."""
    step = WINDOW - OVERLAP
    number = np.where(lengths <= WINDOW, 1, -(-(lengths - WINDOW) // step) + 1)
    of = np.repeat(np.arange(len(lengths)), number)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    within = nth[:, None] * step + np.arange(WINDOW)
    scored = (within < lengths[of][:, None]) & ((np.arange(WINDOW) >= OVERLAP) | (nth == 0)[:, None])
    base = np.cumsum(lengths) - lengths
    return base[of][:, None] + np.minimum(within, lengths[of][:, None] - 1), scored


def text_scores(m: Model, tree: Tree, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each text (ids with their end)."""
    lengths = np.array([len(t) for t in texts])
    first = np.cumsum(lengths) - lengths
    aim = np.concatenate(texts).astype(np.int64)
    read = np.concatenate(([END], aim[:-1]))
    read[first] = END
    before = np.concatenate(([END], read[:-1]))
    before[first] = END
    pair = pair_of(read, before)
    places, scored = _windows(lengths)
    logs = np.empty(len(aim))
    for k in range(0, len(places), 128):  # so few that their arrays stay in a core's cache
        at, use = places[k : k + 128], scored[k : k + 128]
        out = attend(m, read.take(at), pair.take(at))[-1]
        mine = at[use]
        logs[mine] = log_probabilities(m, tree, out[use], aim.take(mine))
    return np.add.reduceat(logs, first) / np.log(10)


def stretches(words: list[bytes], coder: Subwords, round_: int, share: int = SHARE) -> Iterator[np.ndarray]:
    """Ids of the stretches of a text that are learned from in its round, each after the id before it, in runs of a window at most.

    All stretches of a text have the same round, so that a text is turned into ids once.
    """
    if crc32(b" ".join(words)) % ROUNDS != round_:
        return
    number = max(1, -(-len(words) // STRIDE))
    sure = crc32(b" ".join(words[:READ])) % number
    coder.learn(dict.fromkeys(words))
    parts = list(map(coder.__getitem__, words))
    end = np.uint16(END).tobytes()
    ids = np.frombuffer(b"".join((end, *parts, end)), np.uint16)
    edges = [1, *(np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 2 + 1).tolist()]
    for k in range(number):
        if share > 1 and k != sure and (crc32(b" ".join(words[k * STRIDE : k * STRIDE + READ])) >> 8) % share:
            continue
        begin, stop = edges[k * STRIDE] - 1, edges[k * STRIDE + READ] if k * STRIDE + READ < len(words) else len(ids)
        for at in range(begin, stop - 1, WINDOW):
            yield ids[at : min(at + WINDOW + 1, stop)]


class Trainer:
    """AdaGrad on batches of stretches."""

    def __init__(self, m: Model, tree: Tree, rate: float = RATE) -> None:
        self.m, self.tree, self.rate = {name: v.copy() for name, v in m.items()}, tree, rate
        self.seen = {name: np.full(len(v), 1e-2, np.float32) for name, v in self.m.items()}
        self.touched = {name: np.zeros(len(v), np.int64) for name, v in self.m.items()}

    def _step(self, name: str, at: np.ndarray, g: np.ndarray, rate: float) -> None:
        by = np.argsort(at.astype(np.uint16), kind="stable")  # no table has more rows; short numbers are sorted by their digits
        at = at[by]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        g, at = np.add.reduceat(g.take(by, 0), first, 0), at[first]
        seen = self.seen[name][at] + np.einsum("ij,ij->i", g, g) / WIDTH
        self.seen[name][at] = seen
        self.m[name][at] -= (rate / np.sqrt(seen))[:, None] * g
        self.touched[name][at] += 1

    def learn(self, batch: list[np.ndarray]) -> float:
        """One step; gives the loss per id before it."""
        m = self.m
        n = np.fromiter(map(len, batch), np.int64, len(batch)) - 1  # WINDOW at most
        flat = np.concatenate(batch).astype(np.int64)
        places = (np.cumsum(n + 1) - n - 1)[:, None] + np.arange(n.max())
        use = np.arange(n.max()) < n[:, None]
        read = np.where(use, flat.take(places, mode="clip"), END)
        before = np.concatenate((np.full((len(batch), 1), END), read[:, :-1]), 1)
        pair = pair_of(read, before)
        x, q, k, v, a, total, y = attend(m, read, pair)
        a /= total
        used = np.flatnonzero(use)
        narrow = lambda g: g.reshape(-1, WIDTH)
        h = narrow(y).take(used, 0)
        d = decisions(m, self.tree, h, flat.take(places.ravel().take(used) + 1))
        e = np.exp(d.z)
        error = -d.way / (1 + e)
        low = len(m["node"]) - TOP
        high = np.flatnonzero(d.node >= low)
        grid = np.zeros(len(h) * TOP, np.float32)
        grid[d.cell[high]] = error[high]
        grid = grid.reshape(-1, TOP)
        dh = grid @ m["node"][low:]
        of, some = d.of[d.tail], error[d.tail, None]
        if len(of):
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            dh[of[first]] += np.add.reduceat(some * d.units, first, 0)
        dh[:, 0] = 0
        dy = np.zeros_like(y)
        narrow(dy)[used] = dh
        da = dy @ v.transpose(0, 2, 1)
        da -= (da * a).sum(-1, keepdims=True)
        da *= a
        back = np.concatenate((da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dy), 2).reshape(-1, 3 * WIDTH)
        dx = narrow(dy) + back @ np.concatenate((m["q"], m["k"], m["v"]), 1).T
        maps = np.split(narrow(x).T @ back, 3, 1)
        for name, g in (*zip("qkv", maps, strict=True), ("place", dx.reshape(y.shape).sum(0))):
            self._step(name, np.arange(len(g)), g, 0.3 * self.rate)
        met = np.flatnonzero(np.bincount(d.node[high] - low, minlength=TOP))
        self._step("node", np.concatenate((met + low, d.node[d.tail])), np.concatenate(((grid.T @ h)[met], some * h.take(of, 0))), self.rate)
        dx = dx.take(used, 0)
        self._step("own", read.ravel().take(used), dx, self.rate)
        self._step("pair", pair.ravel().take(used), dx, self.rate)
        return float((np.log1p(e) - d.z).sum() / len(used))

    def learn_all(self, texts: Iterable[np.ndarray]) -> None:
        """Runs of a few ids, of which there are many, make steps of their own: less of their windows is empty."""
        long, short = [], []
        for ids in texts:
            batch = long if len(ids) > FEW + 1 else short
            batch.append(ids)
            if len(batch) == (BATCH if batch is long else BATCH * WINDOW // FEW):
                self.learn(batch)
                batch.clear()
        for batch in (long, short):
            if batch:
                self.learn(batch)

    def touched_rows(self) -> np.ndarray:
        return np.concatenate([self.touched[name] for name in _SIZES])


_CHANGES = "slot long, n double, " + ", ".join(f"v{k} double" for k in range(WIDTH))


def fit(docs: DataFrame, counts: np.ndarray, vocabulary: Broadcast, share: int = SHARE) -> tuple[Model, Tree]:
    """The model, learned from all training documents in ``ROUNDS`` rounds."""
    tree = huffman(counts)
    rows = whole(first_model(tree))
    context = docs.sparkSession.sparkContext
    training = docs.filter(~held_out(F.col("doc_id"))).select("text")
    for round_ in range(ROUNDS):
        shared = context.broadcast((rows, tree))

        def run(batches: Iterator[pa.RecordBatch], round_: int = round_, shared=shared) -> Iterator[pa.RecordBatch]:
            rows, tree = shared.value
            coder, trainer = Subwords(vocabulary.value), Trainer(parts(rows), tree, RATE / (1 + round_))
            trainer.learn_all(ids for b in batches for t in b["text"] for ids in stretches(words_of(t.as_py()), coder, round_, share))
            n = trainer.touched_rows()
            slots = np.flatnonzero(n)
            change = (whole(trainer.m)[slots] - rows[slots]) * n[slots][:, None]
            for k in range(0, len(slots), 20_000):
                some = slice(k, k + 20_000)
                columns = [slots[some], n[slots[some]].astype(np.float64), *change[some].T.astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "n", *(f"v{j}" for j in range(WIDTH))])

        changes = training.mapInArrow(run, _CHANGES).groupBy("slot")
        sums = [(F.sum(f"v{k}") / F.sum("n")).alias(f"v{k}") for k in range(WIDTH)]
        found = changes.agg(*sums).toArrow()  # at most ROWS rows
        rows = rows.copy()
        rows[found["slot"].to_numpy()] += np.stack([found[f"v{k}"].to_numpy() for k in range(WIDTH)], 1).astype(np.float32)
    return parts(rows), tree


_PARTS = "rid long, doc_id long, word string, n long, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, vocabulary: str = VOCABULARY, common: int = COMMON, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    counts = word_counts(docs)
    ends = docs.filter(~held_out(F.col("doc_id"))).count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = total + ends
    under = float(np.log10(n_train + 0.5 * (distinct + (ends > 0) + 1)))
    shipped = read_vocabulary(spark, vocabulary)
    ids = id_counts(counts, shipped)
    ids[END] = ends
    model = fit(docs, ids, shipped, share)
    top = counts.orderBy(F.desc("c"), "word").limit(common).toArrow()  # a fixed number of words
    shared = spark.sparkContext.broadcast((top["word"].cast(pa.binary()).to_pylist(), top["c"].to_numpy(), model))
    end_log, has_end = float(np.log10(ends + 0.5)) - under, int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, (m, tree) = shared.value
        logs = dict(zip(words, (np.log10(known + 0.5) - under).tolist(), strict=True))
        coder, rid = Subwords(shipped.value), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in _PARTS.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _PARTS.split(", ")]
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                found, places, ends = split_words(batch["text"])
                found = found.cast(pa.binary()).to_pylist()
                scores = text_scores(m, tree, coder.texts(found, places, ends))
                log = np.array([logs.get(w, np.nan) for w in found])
                sure = ~np.isnan(log)
                size = np.diff(ends, prepend=0)
                of = np.repeat(np.arange(len(size)), size)
                count = lambda x: np.bincount(of, x, len(size))
                base = count(np.where(sure, log, 0.0)[places]) + end_log
                numbers = rid + np.arange(len(size))
                # A document's own row has a blank in place of a word, which no word has, and so is spread evenly.
                none = [f" {x}" for x in numbers]
                known_words = count(sure[places]).astype(np.int64) + has_end
                columns = (numbers, batch["doc_id"], none, np.zeros(len(size), np.int64), size + 1, known_words, base, scores)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                rare = ~sure[places]
                if rare.any():
                    some, times = np.unique(of[rare] * len(found) + places[rare], return_counts=True)
                    words = pa.array([found[x] for x in (some % len(found)).tolist()], pa.binary()).cast(pa.string())
                    nothing = [pa.nulls(len(some), t) for t in kinds[4:]]
                    yield pa.RecordBatch.from_arrays([pa.array(rid + some // len(found), pa.int64()), pa.nulls(len(some), pa.int64()), words, pa.array(times, pa.int64()), *nothing], names)
                rid += len(size)

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PARTS)
    joined = parts.join(counts, "word", "left")
    rare = F.when(F.col("n") > 0, F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - under)).otherwise(F.col("base"))
    known_rare = F.when(F.col("n") > 0, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known"))
    out = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(known_rare).alias("n_known"),
        F.sum(rare).alias("base_score"),
        F.sum("score").alias("score"),
    )
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
