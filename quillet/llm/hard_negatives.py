"""Hard-negative mining by vertical scans in the manner of BOND (operator 12).

For an anchor, the first ``k`` rows of its label by inner product are its positives.
For each of them, the hardest negatives are the first ``k`` rows of other labels
whose score lies between ``share`` percent of the positive's and the positive's itself.

Vectors are packed into blocks of some thousand rows, stored by dimension.  A scan reads an
anchor's dimensions in descending order of its own magnitudes, a few at a time.
What the dimensions still unread can add is bounded by the least and largest value that each has in
the block.  Rows whose bounds leave every window, or fall behind the
``k``-th surest row of one, leave the candidate bitmap; the others go on until their scores are
exact.  Bounds are compared strictly, so rows that tie are never lost.  All arithmetic is
exact: 64-bit integers, or doubles where every sum stays below 2^53.

Anchors are packed, too, and Spark cogroups the two kinds of blocks on a grid of keys: a
block of vectors goes to every block of anchors, which is copied once a group of
vector blocks.  Neither driver nor task holds all anchors or all vectors.  Each cell of the grid, however many
blocks it holds, gives ``k`` rows an anchor and window at most, of which the first are taken by rank.

Edge cases: rows with a null label, a null vector or a component that is null or
not finite take no part.  A null vec_id is no anchor, is not moved to another label, and comes last
among ties.  Rows of one vec_id are rows of their own: each is an anchor, and one may be
the other's positive.  Vectors of different lengths are compared over the shorter;
an empty one scores 0.  Components are clamped at 2^31 / sqrt(length) after
scaling, so that scores fit in a long.  A negative positive score has no window.
Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: Rows of a block of vectors, and anchors of a block of anchors.
VECTORS, ANCHORS = 4096, 4096
#: Blocks of vectors that meet a block of anchors in one task at most.
CELL = 32
#: Dimensions read between two looks at the bounds.
STEP = 8

_PACKED = "block long, rids binary, ids binary, unknown binary, labels binary, windows binary, dims int, cols binary"


class Block(NamedTuple):
    """Rows in order of label; ``cols`` has one row per dimension, ``windows`` the positives' scores of an anchor, -1 where there is none."""

    rids: np.ndarray
    ids: np.ndarray
    unknown: np.ndarray
    labels: np.ndarray
    windows: np.ndarray
    cols: np.ndarray


def vectors(rows: DataFrame) -> DataFrame:
    """(rid, vec_id, label, v): rows that take part, components as floor(256 x), every seventh vec_id under the next label."""
    usable = "label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    most = "floor(2147483647 / sqrt(greatest(size(embedding), 1)))"
    return rows.filter(usable).select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.expr("if(vec_id % 7 = 0, (label + 1L) % 10L, cast(label as long))").alias("label"),
        F.expr(f"transform(embedding, x -> cast(greatest(-{most}, least({most}, floor(256 * greatest(-1e12, least(1e12, double(x)))))) as int))").alias("v"),
    )


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    n = table.num_rows
    label = table["label"].to_numpy()
    order = np.argsort(label, kind="stable")
    lists = pa.concat_arrays(table["v"].chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    wide = np.zeros((n, int(sizes.max(initial=0))), np.int32)
    wide[np.arange(wide.shape[1]) < sizes[:, None]] = flat
    ids = pa.concat_arrays(table["vec_id"].chunks)
    windows = np.array([[*w, *[-1] * 8][:8] for w in table["windows"].to_pylist()], np.int64).reshape(n, 8)
    put = lambda x, kind: [np.ascontiguousarray(x, kind).tobytes()]
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int64()),
            "rids": put(table["rid"].to_numpy()[order], np.int64),
            "ids": put(ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[order], np.int64),
            "unknown": put(ids.is_null().to_numpy(zero_copy_only=False)[order], np.uint8),
            "labels": put(label[order], np.int64),
            "windows": put(windows[order], np.int64),
            "dims": pa.array([wide.shape[1]], pa.int32()),
            "cols": put(wide[order].T, np.int32),
        }
    )


def packed(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (rid, vec_id, label, v, windows) as ``n`` blocks of about the same size, dealt by the hash of rid."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(n)))
    return dealt.groupBy("block").applyInArrow(_pack, _PACKED)


def _block(row: dict, prefix: str) -> Block:
    get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
    rids = get("rids", np.int64)
    cols = get("cols", np.int32).reshape(row[prefix + "dims"], len(rids))
    return Block(rids, get("ids", np.int64), get("unknown", np.uint8), get("labels", np.int64), get("windows", np.int64).reshape(len(rids), 8), cols)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first rows: higher scores, then smaller ids."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def scan(anchor: np.ndarray, cols: np.ndarray, least: np.ndarray, most: np.ndarray, bitmap: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], k: int, read: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, scores) of the first ``k`` candidates of each window (lowest, highest score).

    ``cols`` are the dimensions, ``least`` and ``most`` their bounds, ``bitmap`` the candidates.  ``read`` is
    given the number of components looked at.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * least, anchor * most])[:, order]
    low, high = (np.concatenate([np.cumsum(x[::-1])[::-1], np.zeros(1, x.dtype)]) for x in (ends.min(0), ends.max(0)))
    at = np.flatnonzero(bitmap)
    score = np.zeros(len(at), cols.dtype)
    for begin in range(0, len(order), STEP):
        dims = order[begin : begin + STEP]
        score += anchor[dims] @ (cols[dims] if len(at) == cols.shape[1] else cols[np.ix_(dims, at)])
        if read is not None:
            read.append(len(dims) * len(at))
        after = min(begin + STEP, len(order))
        lo, hi = score + low[after], score + high[after]
        alive = np.zeros(len(at), bool)
        for floor, ceiling in windows:
            within = (lo <= ceiling) & (hi >= floor)
            sure = lo[(hi <= ceiling) & (lo >= floor)]
            if len(sure) >= k:
                within &= hi >= np.partition(sure, len(sure) - k)[len(sure) - k]
            alive |= within
        if not alive.all():
            at, score = at[alive], score[alive]
        if not len(at):
            break
    out = []
    for floor, ceiling in windows:
        inside = np.flatnonzero((score >= floor) & (score <= ceiling))
        first = inside[_first(score[inside], ids[at[inside]], k)]
        out.append((at[first], score[first].astype(np.int64)))
    return out


def _scan_cells(negatives: bool, k: int, share: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The work on a block of anchors and some of vectors: per anchor the first rows of its own label, or of the others per window."""
    reach = np.iinfo(np.int64).max

    def pair(a: Block, v: Block) -> Iterator[tuple]:
        dims = min(len(a.cols), len(v.cols))
        wide, narrow = v.cols[:dims], a.cols[:dims]
        bound = int(dims * max(1, np.abs(wide.astype(np.int64)).max(initial=0)) * max(1, np.abs(narrow.astype(np.int64)).max(initial=0)))
        kind = np.float64 if bound < 2**53 else np.int64
        cols = wide.astype(kind)
        least, most = (f(1) if cols.size else np.zeros(dims, kind) for f in (cols.min, cols.max))
        anchors = narrow.T.astype(kind)
        starts, stops = np.searchsorted(v.labels, a.labels, "left"), np.searchsorted(v.labels, a.labels, "right")
        for i in range(len(a.rids)):
            own = slice(starts[i], stops[i])
            bitmap = np.zeros(len(v.rids), bool)
            if negatives:
                bitmap[:] = True
                bitmap[own] = False
                scores = [int(x) for x in a.windows[i] if x >= 0]
                windows = [(-(-share * x // 100), x) for x in scores]
            else:
                bitmap[own] = v.rids[own] != a.rids[i]
                windows = [(-reach, reach)]
            if windows and bitmap.any():
                for w, (at, score) in enumerate(scan(anchors[i], cols, least, most, bitmap, v.ids, windows, k)):
                    for p, s in zip(at, score):
                        yield int(a.rids[i]), scores[w] if negatives else -1, int(s), int(v.ids[p]), bool(v.unknown[p])

    def cell(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        best = _first_rows(np.zeros((0, 5), np.int64), k)
        for a in anchors.to_pylist():
            for i in range(blocks.num_rows):  # one block at a time is taken apart
                found = list(pair(_block(a, "a_"), _block(blocks.slice(i, 1).to_pylist()[0], "v_")))
                if found:
                    best = _first_rows(np.concatenate([best, np.array(found, np.int64)]), k)
        rid, window, score, ids, unknown = best.T
        columns = (pa.array(rid), pa.array(window, mask=window < 0), pa.array(score), pa.array(ids), pa.array(unknown > 0))
        return pa.Table.from_arrays(list(columns), ["anchor_rid", "window", "score", "id", "unknown"])

    return cell


def _first_rows(found: np.ndarray, k: int) -> np.ndarray:
    """Of rows (anchor, window, score, id, unknown) the ``k`` first of each anchor and window."""
    found = found[np.lexsort((found[:, 4], found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
    begin = np.flatnonzero(np.r_[True, (np.diff(found[:, :2], axis=0) != 0).any(1)]) if len(found) else np.zeros(0, np.int64)
    place = np.arange(len(found)) - np.repeat(begin, np.diff(np.r_[begin, len(found)]))
    return found[place < k]


def _search(anchors: DataFrame, blocks: DataFrame, n_anchors: int, n_blocks: int, negatives: bool, k: int, share: int) -> DataFrame:
    """(anchor_rid, window, score, id, unknown, rank): the first ``k`` rows of each anchor and window over all blocks.

    A cell of the grid holds a block of anchors and ``CELL`` blocks of vectors at most, whatever the
    table's size, and gives ``k`` rows an anchor and window.
    """
    groups = max(min(n_blocks, 2 * shuffle_partitions(blocks.sparkSession)), -(-n_blocks // CELL))
    name = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    a = name(packed(anchors, n_anchors), "a_").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    v = name(blocks, "v_").withColumn("g", (F.col("v_block") % groups).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_anchors - 1).cast("long"))))
    cells = a.groupBy("a_block", "g").cogroup(v.groupBy("at", "g"))
    found = cells.applyInArrow(_scan_cells(negatives, k, share), "anchor_rid long, window long, score long, id long, unknown boolean")
    first = W.partitionBy("anchor_rid", "window").orderBy(F.desc("score"), "id", "unknown")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 100, k: int = 5, share: int = 80, block_vectors: int = VECTORS, block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every ``every``-th vec_id."""
    if not 1 <= k <= 8 or not 0 <= share <= 100:
        raise ValueError("k is from 1 to 8 and share a percentage")
    table = cut(vectors(rows))
    is_anchor = F.col("vec_id") % every == 0
    n, m = table.agg(F.count("*"), F.count_if(is_anchor)).first()
    n_blocks, n_anchors = max(1, -(-n // block_vectors)), max(1, -(-m // block_anchors))
    none = F.lit(None).cast("array<bigint>")
    blocks = cut(packed(table.withColumn("windows", F.coalesce(none, F.array())), n_blocks))
    anchors = table.filter(is_anchor)
    bare = anchors.withColumn("windows", F.coalesce(none, F.array()))
    found = _search(bare, blocks, n_anchors, n_blocks, False, k, share)
    positives = cut(found.select(F.col("anchor_rid").alias("rid"), F.col("rank").alias("place"), F.when(~F.col("unknown"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score")))
    windows = positives.filter("positive_score >= 0").groupBy("rid").agg(F.collect_set("positive_score").alias("windows"))  # k at most
    negatives = _search(anchors.join(windows, "rid"), blocks, n_anchors, n_blocks, True, k, share)
    negatives = negatives.select(F.col("anchor_rid").alias("rid"), F.col("window").alias("positive_score"), "rank", F.when(~F.col("unknown"), F.col("id")).alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("rid", F.col("vec_id").alias("anchor_id"))
    return positives.join(negatives, ["rid", "positive_score"]).join(named, "rid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
