"""Repeated passages by suffix sorting (operator 6).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
document with a smaller doc_id, or earlier in the same one.  Strings are judged
on the input.

Which suffixes have to be sorted
    Each window of ``LENGTH`` bytes is owned by the place of its least hash of
    ``GRAM`` bytes (the leftmost, if equal), which depends on the window's bytes
    alone.  Equal windows therefore have owners with equal hashes, at the same
    offset.  Owners whose hash occurs once in the corpus own no repeated window;
    the others have their surroundings (at most 2 * LENGTH bytes) sent to one
    task per hash.  That is an exact filter: no repeated window is lost.

Deep-shallow sorting (``ranks``)
    Multikey quicksort to a shallow depth: a suffix's character is a word of eight
    bytes, each group is split in three about a pivot word, and only the middle
    part goes one word deeper.  All groups of a chunk take each step together, so
    a step is a few numpy passes.  Groups that still agree after ``SHALLOW`` bytes
    go to blind tries.  Suffixes that agree over ``LENGTH`` bytes share a rank; all
    but the earliest are removed.
    First the surroundings are ranked by their first and last windows, which
    together cover them, so that equal ones are sorted on once; then the windows
    of those that differ are ranked, offset by offset.

Scale: the texts are shuffled once (the exchange by key is reused by the three
steps that need texts), owners travel as a few numbers each.  Hot passages are
combined before each shuffle: of equal hashes in one stretch of text one goes to
the task of the hash; of equal surroundings in one task the earliest goes, and the
others are removed on the spot, since their strings surely start earlier
elsewhere.  What is left of a hash comes in sorted order, in batches, and is held
as distinct surroundings only.  Whole copies of a text are found by digest
beforehand, also combined before the shuffle.

Keys: doc_ids where they are unique; else the rows are sorted by doc_id (null
last), written to the shared folder and numbered in that order.

Edge cases: a null text has no bytes; a text under ``LENGTH`` bytes is kept whole;
a null doc_id comes after all others; rows that share a doc_id are documents of
their own, one after the other; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_or_empty, written

LENGTH = 100
GRAM = 24
SHALLOW = 32
_REACH = LENGTH - GRAM + 1
_SEGMENT = 1 << 18
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Surroundings that a task keeps to combine equal ones, and rows that it sorts at once.
_COMBINE = 100_000
_CHUNK = 20_000
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
_OWNED = "h long, key long, at long"
#: In an owner's number: its hash was seen twice already; there is nothing left to be asked about it.
_SEVERAL, _LATER = 1 << 15, 1 << 7
_LOW = 127
_AROUND = "route long, key long, at long, bytes binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A polynomial hash of every ``GRAM`` bytes."""
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    h = _TABLE[data]
    for k in (1, 2, 4):
        h = h[:-k] * power(k) + h[k:]
    long = h[:-8] * power(8) + h[8:]
    return long[:-8] * power(8) + h[16:]


def owners(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, place, first and last owned window; ``ends`` are the ends of the texts in ``data``.

    ``data`` has at most ``_SEGMENT`` bytes.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    with np.errstate(over="ignore"):
        h = gram_hashes(data)
        least = (h * np.uint64(_BASE)) & ~np.uint64(_SEGMENT - 1) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-k], least[k:])
    least = np.minimum(least[: n], least[_REACH - 64 :][:n])
    place = (least & np.uint64(_SEGMENT - 1)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n, bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        inside[a : max(a, b - LENGTH + 1)] = True
    change = np.flatnonzero((place[1:] != place[:-1]) | (inside[1:] != inside[:-1])) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [n])) - 1
    good = inside[first]
    first, last = first[good], last[good]
    return h[place[first]], place[first], first, last


def _spread(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A route for rows that have nothing left to be compared with."""
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * np.uint64(_BASE) + at.astype(np.uint64)).view(np.int64) * np.int64(0x2545F4914F6CDD1D)


def _long(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in columns]


def _find_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, key, at: at packs the owner's place, how far its windows reach back, and two flags.

    Of the owners of one hash in a stretch of text, only the first has to go to the
    hash's task; all of them are known to be repeated.
    """

    def flush(segment: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ends = np.cumsum([len(x[2]) for x in segment])
        h, place, first, last = owners(np.frombuffer(b"".join(x[2] for x in segment), np.uint8), ends)
        of = np.searchsorted(ends, first, "right")
        base = np.array([x[1] for x in segment]) - np.concatenate(([0], ends[:-1]))
        key = np.array([x[0] for x in segment], np.int64)[of]
        at = (place + base[of] << 16) | (place - first << 8) | (place - last)
        by = np.argsort(h, kind="stable")
        same = h[by][1:] == h[by][:-1]
        later, several = np.zeros(len(h), bool), np.zeros(len(h), bool)
        later[by[1:][same]] = True
        several[by[1:][same]] = several[by[:-1][same]] = True
        return pa.RecordBatch.from_arrays(_long(h.view(np.int64), key, at + several * _SEVERAL + later * _LATER), ["h", "key", "at"])

    for batch in batches:
        segment, size = [], 0
        for key, text, copy in zip(batch["key"].to_pylist(), batch["text"], batch["copy"].to_pylist(), strict=True):
            data = b"" if copy else text.as_py().encode()
            for k in range(0, max(len(data) - LENGTH + 1, 0), _SEGMENT - LENGTH):
                part = data[k : k + _SEGMENT - 1]
                if size + len(part) > _SEGMENT:
                    yield flush(segment)
                    segment, size = [], 0
                segment.append((key, k, part))
                size += len(part)
        if segment:
            yield flush(segment)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owners with their bytes; without bytes where an equal one of this task comes earlier."""
    earliest: dict[tuple[int, int, bytes], tuple[int, int]] = {}
    for batch in batches:
        hs, keys, ats, found = [], [], [], []
        for key, text, places in zip(batch["key"].to_pylist(), batch["text"], batch["places"].to_pylist(), strict=True):
            data = text.as_py().encode()
            for p in places:
                h, at = p["h"], p["at"]
                start = (at >> 16) - (at >> 8 & _LOW)
                mine = data[start : (at >> 16) - (at & _LOW) + LENGTH]
                known = earliest.get((h, at & 65535, mine))
                if known is None or (key, start) < known:
                    if len(earliest) >= _COMBINE:
                        earliest.clear()
                    earliest[h, at & 65535, mine] = (key, start)
                else:
                    mine = None
                hs.append(h)
                keys.append(key)
                ats.append(at)
                found.append(mine)
        h, key, at = (np.array(c, np.int64) for c in (hs, keys, ats))
        alone = np.fromiter((x is None for x in found), bool, len(found))
        route = np.where(alone, _spread(key, at), h)
        yield pa.RecordBatch.from_arrays([*_long(route, key, at), pa.array(found, pa.binary())], ["route", "key", "at", "bytes"])


def shallow_groups(words: np.ndarray, starts: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort inside each segment down to ``SHALLOW`` bytes.

    Gives the suffixes in order and, for each, the rank that it shares with those
    that agree on ``SHALLOW`` bytes.  ``words`` has the eight bytes from each place on.
    ``segment`` ascends.
    """
    order, rank = np.arange(len(starts)), np.arange(len(starts))
    slot = np.arange(len(starts))  # the places in the order that are not settled yet
    edge = np.concatenate(([True], segment[1:] != segment[:-1])) if len(starts) else np.empty(0, bool)
    depth = np.zeros(len(starts), np.int64)
    while len(slot):
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(slot)))
        open_ = (size > 1) & (depth[first] < SHALLOW)
        keep = np.repeat(open_, size)
        done = np.repeat(first, size)[~keep]
        rank[slot[~keep]] = slot[done]
        slot, depth = slot[keep], depth[keep]
        if not len(slot):
            break
        size = size[open_]
        group = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        now = order[slot]
        word = words[starts[now] + depth]
        pivot = word[first + size // 2][group]
        part = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        to, before = np.empty(len(slot), np.int64), first.copy()
        for k in range(3):
            mine = part == k
            upto = np.cumsum(mine)
            start = upto[first] - mine[first]
            to[mine] = (before[group] + upto - 1 - start[group])[mine]
            before += np.add.reduceat(mine, first)
        moved, parts = np.empty_like(now), np.empty_like(part)
        moved[to], parts[to] = now, part
        order[slot] = moved
        edge = np.concatenate(([True], (group[1:] != group[:-1]) | (parts[1:] != parts[:-1])))
        depth = depth + 8 * (parts == 1)
    return order, rank


def blind_trie(data: bytes, starts: list[int]) -> list[list[int]]:
    """Classes of suffixes that agree on ``LENGTH`` bytes, in suffix order.

    A node is [depth, {byte: node}]; a leaf is a list of the indexes of equal
    suffixes.  A suffix goes down blindly, comparing one byte per node, is
    compared once with the leaf it reaches, and is attached where they part.
    """
    root: list | dict = [0]

    def text(i: int) -> bytes:
        return data[starts[i] : starts[i] + LENGTH]

    nodes: list = [("leaf", [0])]
    for i in range(1, len(starts)):
        mine = text(i)
        path, at = [], root[0]
        while nodes[at][0] != "leaf":
            path.append(at)
            _, depth, children = nodes[at]
            at = children.get(mine[depth], next(iter(children.values())))
        other = text(nodes[at][1][0])
        if mine == other:
            nodes[at][1].append(i)
            continue
        apart = int.from_bytes(mine) ^ int.from_bytes(other)
        lcp = LENGTH - (apart.bit_length() + 7) // 8
        leaf = len(nodes)
        nodes.append(("leaf", [i]))
        above = [k for k in path if nodes[k][1] <= lcp]
        if above and nodes[above[-1]][1] == lcp:
            nodes[above[-1]][2][mine[lcp]] = leaf
            continue
        below = path[len(above)] if len(above) < len(path) else at
        split = len(nodes)
        nodes.append(("node", lcp, {other[lcp]: below, mine[lcp]: leaf}))
        if above:
            nodes[above[-1]][2][mine[nodes[above[-1]][1]]] = split
        else:
            root[0] = split
    out, stack = [], [root[0]]
    while stack:
        node = nodes[stack.pop()]
        if node[0] == "leaf":
            out.append(node[1])
        else:
            stack += [node[2][c] for c in sorted(node[2], reverse=True)]
    return out


def ranks(data: bytes, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of ``data`` inside their segments, equal where ``LENGTH`` bytes agree.

    ``data`` has eight bytes or more after the last string; ``segment`` ascends.
    """
    words = np.ndarray((max(len(data) - 7, 0),), ">u8", data, 0, (1,))
    order, shared = shallow_groups(words, starts, segment)
    out = np.empty(len(starts), np.int64)
    out[order] = shared
    first = np.flatnonzero(np.concatenate(([True], shared[1:] != shared[:-1]))) if len(starts) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(starts)))
    deep = size > 1
    first, size = first[deep], size[deep]
    if not len(first):
        return out
    member = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    mine, head = starts[order[member]], np.repeat(starts[order[first]], size)
    equal = np.ones(len(member), bool)
    for k in (*range(SHALLOW, LENGTH - 8, 8), LENGTH - 8):
        equal &= words[mine + k] == words[head + k]
    # A trie whose first leaf takes all needs no building.
    mixed = ~np.logical_and.reduceat(equal, np.cumsum(size) - size)
    for a, n in zip(first[mixed].tolist(), size[mixed].tolist(), strict=True):
        group = order[a : a + n]
        for same in blind_trie(data, starts[group].tolist()):
            out[group[same]] = a
            a += len(same)
    return out


class _Surroundings:
    """Rows (key, at, bytes) in groups of equal hashes, as arrays."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]) -> None:
        self.h, self.key, at = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.at, self.bytes = at, [r[3] for r in rows]
        self.place, self.back, self.ahead = at >> 16, at >> 8 & _LOW, at & _LOW
        self.start, self.end = self.place - self.back, self.place - self.ahead + LENGTH
        self.data = b"".join(self.bytes) + bytes(8)
        sizes = np.fromiter(map(len, self.bytes), np.int64, len(rows))
        self.base = np.cumsum(sizes) - sizes
        self.last = self.base + sizes - LENGTH
        self.group = np.cumsum(np.concatenate(([0], self.h[1:] != self.h[:-1]))) if rows else np.empty(0, np.int64)

    def earliest(self) -> np.ndarray:
        """Whether each row is the earliest of those with equal bytes about the same place."""
        kind = ranks(self.data, np.concatenate((self.base, self.last)), np.concatenate((self.group, self.group + len(self.h))))
        first, last = kind[: len(self.h)], kind[len(self.h) :]
        by = np.lexsort((self.start, self.key, self.ahead, self.back, last, first))
        new = np.zeros(len(by), bool)
        for column in (first, last, self.back, self.ahead):
            new[1:] |= column[by][1:] != column[by][:-1]
        new[:1] = True
        out = np.zeros(len(by), bool)
        out[by] = new
        return out

    def spans(self, chosen: np.ndarray) -> list[tuple[int, int, int]]:
        return list(zip(self.key[chosen].tolist(), self.start[chosen].tolist(), self.end[chosen].tolist(), strict=True))

    def repeated_windows(self) -> list[tuple[int, int, int]]:
        """Spans of the windows that also start earlier; no two rows are equal."""
        of_two = np.bincount(self.group)[self.group] > 1 if len(self.group) else np.empty(0, bool)
        out: list[tuple[int, int, int]] = []
        # Equal windows lie at the same offset from their owners.
        for offset in range(_REACH if of_two.any() else 0):
            i = np.flatnonzero(of_two & (self.ahead <= offset) & (offset <= self.back))
            if len(i) < 2:
                continue
            rank = ranks(self.data, self.base[i] + self.back[i] - offset, self.group[i])
            by = np.lexsort((self.place[i], self.key[i], rank))
            later = by[1:][rank[by][1:] == rank[by][:-1]]
            a = self.place[i[later]] - offset
            out += zip(self.key[i[later]].tolist(), a.tolist(), (a + LENGTH).tolist(), strict=True)
        return out


def _joined(spans: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Spans as batches; those that meet are one."""
    if spans:
        key, start, end = (np.array(c, np.int64) for c in zip(*spans, strict=True))
        by = np.lexsort((end, start, key))
        key, start, end = key[by], start[by], end[by]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] > end[:-1])))
        first = np.flatnonzero(new)
        end = np.maximum.reduceat(end, first)
        for k in range(0, len(first), 50_000):
            some = first[k : k + 50_000]
            yield pa.RecordBatch.from_arrays(_long(key[some], start[some], end[k : k + 50_000]), ["key", "start", "end"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove: (key, start, end).  The rows of a hash come together."""

    def distinct(rows: list, spans: list) -> list:
        around = _Surroundings(rows)
        stays = around.earliest()
        spans += around.spans(~stays)
        return [rows[i] for i in np.flatnonzero(stays).tolist()]

    held: list[tuple[int, int, int, bytes]] = []
    limit = _CHUNK
    for batch in batches:
        spans: list[tuple[int, int, int]] = []
        columns = (batch[c].to_pylist() for c in ("route", "key", "at", "bytes"))
        for row in zip(*columns, strict=True):
            if row[3] is None:
                at = row[2]
                spans.append((row[1], (at >> 16) - (at >> 8 & _LOW), (at >> 16) - (at & _LOW) + LENGTH))
                continue
            if len(held) >= limit:
                # The last hash may go on; the others are complete.
                n = len(held)
                while n and held[n - 1][0] == row[0]:
                    n -= 1
                if n:
                    spans += _Surroundings(distinct(held[:n], spans)).repeated_windows()
                held = distinct(held[n:], spans) if len(held) - n else []
                limit = max(_CHUNK, 2 * len(held))
            held.append(row)
        yield from _joined(spans)
    spans = []
    if held:
        spans += _Surroundings(distinct(held, spans)).repeated_windows()
    yield from _joined(spans)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = []
        columns = (batch[c].to_pylist() for c in ("key", "text", "copy", "spans"))
        for doc_id, text, copy, spans in zip(*columns, strict=True):
            data = text.encode()
            merged: list[list[int]] = [[0, len(data)]] if copy and len(data) >= LENGTH else []
            for span in sorted((s["start"], s["end"]) for s in spans or () if not copy):
                if merged and span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            kept, last = hashlib.sha256(), 0
            for a, b in merged:
                kept.update(data[last:a])
                last = b
            kept.update(data[last:])
            found = [{"start": a, "end": b} for a, b in merged]
            rows.append((doc_id, len(data), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), found))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _keyed(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, text), and (key, doc_id) where keys are not the doc_ids.

    Keys are unique and ascend as doc_ids do, null last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Never null here; said so that joins by key need no filter below the exchange of the texts, which is then one for all.
    sure = F.coalesce("doc_id", F.lit(0).cast("long"))
    if rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return rows.select(sure.alias("key"), "text"), None
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.monotonically_increasing_id().asc()]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order[:2])
    table = written(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "texts")
    return table.select(F.coalesce("key", F.lit(0).cast("long")).alias("key"), "text"), table.select("key", "doc_id")


def remove_repeats(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row of ``docs``."""
    n = partitions or shuffle_partitions(docs.sparkSession)
    rows, ids = _keyed(docs, n)
    firsts = rows.groupBy(F.sha2(F.encode("text", "UTF-8"), 256)).agg(F.min("key").alias("key")).select("key", F.lit(False).alias("copy"))
    texts = rows.repartition(n, "key").join(firsts, "key", "left").select("key", "text", F.coalesce("copy", F.lit(True)).alias("copy"))
    route = F.expr(f"if(at & {_LATER} = 0, h, xxhash64(key, at))")
    owned = texts.mapInArrow(_find_owners, _OWNED).repartition(n, route).withColumn("route", route)
    met = owned.withColumn("n", F.count("*").over(W.partitionBy("route"))).filter(f"n > 1 OR at & {_SEVERAL} <> 0")
    at = F.expr(f"at & ~{_SEVERAL + _LATER}L")
    places = met.groupBy("key").agg(F.collect_list(F.struct("h", at.alias("at"))).alias("places"))
    around = texts.select("key", "text").join(places, "key").mapInArrow(_surroundings, _AROUND)
    gone = around.repartition(n, "route").sortWithinPartitions("route").mapInArrow(_removed, "key long, start long, end long")
    spans = gone.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = texts.join(spans, "key", "left").select("key", "text", "copy", "spans").mapInArrow(_apply, OUT)
    if ids is None:
        return out
    return out.withColumnRenamed("doc_id", "key").join(ids, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
