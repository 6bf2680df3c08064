"""Toxicity by FTRL-proximal logistic regression over hashed n-grams (operator 8).

Features of a text: hashed words, word pairs and pairs with one word left out
(skip-grams), present or absent, in 2**``BITS`` slots.  Each coordinate has its own
learning rate and an L1 penalty that leaves most weights at zero.

Training uses at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id; that is the documented bound.  They are dealt to tasks of about ``SHARD_ROWS``, each
trains its own weights, and Spark averages them.  The weights (at most 2**``BITS``
numbers, a few thousand in practice) are the only thing that is broadcast.
Scoring is one map over whole texts without a shuffle.  Only the text enters a
score: labels, language, source and id never do.

Edge cases: a null or empty text gets the score of the bias alone; ids that are
labelled twice take their largest label; of several rows under one id the least
text is learned from; without labelled rows all weights are
zero and every score is 0.5; repeated rows are scored one by one; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS = 20
SAMPLE = 24_000
SHARD_ROWS = 4_000
EPOCHS = 6
ALPHA, BETA, L2 = 2.0, 1.0, 1.0
#: The L1 penalty of a full shard; a smaller one has it in proportion.
L1 = 15.0
POSITIVE_WEIGHT = 5.0
#: A slot enters a shard's training once so many of its texts have it.
SEEN = 5
THRESHOLD = 0.7
#: A-Z to a-z, other ASCII than letters and digits to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR, _SKIP = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(text: str | None) -> np.ndarray:
    """Slots of all words, pairs and skip-pairs, repeats included."""
    words = (text or "").encode().translate(_FOLD).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    with np.errstate(over="ignore"):
        grams = np.concatenate((h * _MIX, (h[:-1] * _PAIR + h[1:]) * _MIX, (h[:-2] * _SKIP + h[2:] * _PAIR) * _MIX))
    return (grams >> np.uint64(64 - BITS)).astype(np.int64)


def train(texts: list[str], labels: list[int]) -> np.ndarray:
    """FTRL-proximal weights; slot 2**BITS is the bias."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    rows = [np.unique(features(t)) for t in texts]
    seen = np.zeros(2**BITS, np.int64)
    for at in rows:
        seen[at] += 1
    rows = [np.append(at[seen[at] >= SEEN], 2**BITS) for at in rows]

    l1 = max(0.5, L1 * min(1.0, len(rows) / SHARD_ROWS))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at = rows[k]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            if labels[k]:
                g *= POSITIVE_WEIGHT
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(2**BITS + 1))


def _train_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for b in batches for r in b.to_pylist())
    if rows:
        w = train([r[2] for r in rows], [r[1] for r in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], 1.0))], ["slot", "w"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Averaged weights from at most ``sample`` rows that are labelled and not held out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = cut(chosen)
    number = max(1, round(chosen.count() / SHARD_ROWS))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by the sample
    # One row an id, so that the sample bounds the training, too.
    rows = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    shards = rows.repartition(number, F.xxhash64("doc_id", F.lit(7)))
    parts = shards.mapInArrow(_train_shard, "slot long, w double")
    found = parts.groupBy("slot").agg(F.sum("w").alias("w")).toPandas()  # at most 2**BITS + 2 rows
    out = np.zeros(2**BITS + 1)
    number = found.w[found.slot == -1].sum() or 1
    used = found[found.slot >= 0]
    out[used.slot.to_numpy()] = used.w.to_numpy() / number
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, some = shared.value
        w = np.zeros(2**BITS + 1, np.float32)
        w[at] = some
        for batch in batches:
            scores = []
            for text in batch["text"]:
                found = features(text.as_py())
                total = w[np.unique(found[w[found] != 0])].sum(dtype=np.float64) + float(w[-1])
                scores.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
