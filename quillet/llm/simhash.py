"""SimHash near-duplicates by pigeonhole blocks (operator 5).

Fingerprint: A-Z is lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, features are
all 3-word shingles of the whole text (repeats count; a shorter text is one
shingle; no words: fingerprint zero).  A feature's hash is XXH64 with seed 42; a
bit of the fingerprint is 1 if it is set in over half of the hashes.

Links: fingerprints that differ in at most three bits.  The 64 bits are cut
into five blocks; three differing bits touch at most three of them, so two
blocks agree whole.  Each distinct fingerprint is filed under its ten pairs of
blocks (some 26 bits a key), and the pairs under one key are verified by their
Hamming distance.  Equal texts, however many, are one fingerprint before
anything is joined.

A key with more than ``GROUP`` fingerprints is not compared pair by pair: its
fingerprints are filed again under all choices of 13 out of 16 blocks of four
bits (560 keys, 52 bits each), where a key cannot hold more than 4,096
fingerprints.  That is exact too; no link is lost and no group is unbounded.
Inside a group only the links of a spanning forest are emitted, never all pairs.

Components come from ``connected_components``; ids stay in Spark throughout.

Edge cases: null and empty texts have fingerprint zero and are one class; a
component's id is its smallest doc_id, null where all are null; repeated rows are
rows of their own, and ``keep_representatives`` keeps exactly one row of each
component (smallest doc_id, null last, then any one row); extra columns are
ignored by ``near_duplicates`` and kept by ``keep_representatives``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_row_ids
from .components import connected_components

BITS = 3
SHINGLE = 3
GROUP = 2048
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        some = [digest(joined[a:b], 42) for a, b in zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK], strict=True)]
        octets = np.array(some, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64)
        yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], pa.array(prints.view(np.int64))], ["rid", "doc_id", "fp"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """rid, doc_id and fp (the 64 bits as a long) of every row (rid, doc_id, text)."""
    narrow = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_fingerprints, "rid long, doc_id long, fp long")


def _masks(blocks: int) -> list[int]:
    """All-but-``BITS`` of the blocks, as masks of a long."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(some) for some in combinations(block, blocks - BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _filed(prints: DataFrame, blocks: int) -> DataFrame:
    masks = F.array(*[F.lit(m) for m in _masks(blocks)])
    return prints.select("fp", F.posexplode(masks).alias("table", "mask")).select("fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links within ``BITS`` that connect whatever the group's links connect."""
    links, left = [], prints.view(np.uint64)  # bitwise_count of a signed number counts the bits of its absolute value
    if len(left) == 2:
        return [(int(prints[0]), int(prints[1]))] if np.bitwise_count(left[0] ^ left[1]) <= BITS else []
    while len(left):
        found, left = [left[0]], left[1:]
        while found and len(left):
            one = found.pop()
            near = np.bitwise_count(left ^ one) <= BITS
            if near.any():
                links += [(int(one.view(np.int64)), int(x)) for x in left[near].view(np.int64)]
                found += list(left[near])
                left = left[~near]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets = batch["fps"].offsets.to_numpy()
        values = batch["fps"].values.to_numpy()
        links = [x for a, b in zip(offsets, offsets[1:], strict=False) for x in forest(values[a:b])]
        pairs = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _grouped_links(filed: DataFrame) -> DataFrame:
    groups = filed.groupBy("table", "key").agg(F.collect_list("fp").alias("fps"))
    return groups.filter(F.size("fps") > 1).select("fps").mapInArrow(_links, "a long, b long")


def links(prints: DataFrame, blocks: int = 5, group: int = GROUP) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` that span their components."""
    filed = _filed(prints, blocks)
    counts = cut(filed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = filed.join(counts, ["table", "key"])
    found = _grouped_links(shared.filter(F.col("n") <= group))
    crowded = counts.filter(F.col("n") > group)
    if not crowded.isEmpty():
        dense = cut(shared.filter(F.col("n") > group).select("fp").distinct())
        found = found.unionByName(_grouped_links(_filed(dense, 16)))
    return found


def _roots(prints: DataFrame, blocks: int, group: int) -> DataFrame:
    """(fp, root): each distinct fingerprint with the root of its component."""
    classes = cut(prints.select("fp").distinct())
    roots = connected_components(links(classes, blocks, group))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, blocks: int = 5, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of ``docs``."""
    prints = cut(fingerprints(docs.select(F.lit(0).cast("long").alias("rid"), "doc_id", "text")))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    rooted = _roots(prints, blocks, group).join(classes, "fp")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = rooted.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(of_class, "fp").select("doc_id", hexed, "component_id")


def keep_representatives(docs: DataFrame, blocks: int = 5, group: int = GROUP) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, with all its columns."""
    rows = with_row_ids(docs)
    prints = cut(fingerprints(rows.select("rid", "row.doc_id", "row.text")))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    classes = prints.groupBy("fp").agg(F.min(first).alias("first"))
    kept = _roots(prints, blocks, group).join(classes, "fp").groupBy("root").agg(F.min("first").alias("first"))
    return rows.join(kept.select("first.rid"), "rid", "left_semi").select("row.*")
