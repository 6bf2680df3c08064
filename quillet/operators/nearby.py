"""Receipts that lie together by vendor and day in a task: which are near, and how alike their texts are."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are looked at together.
PAIRS = 1 << 16
#: Characters told apart by a text table, and characters of a text that it takes.
_CODES, _WORD = 256, 64
#: Regions of two texts that are searched together.
_REGIONS = 1_024


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups with the number of each row's; rows of equal ``by`` come one after the other."""

    def numbered(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, np.int64)
        for c in by:
            new[1:] |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)).to_numpy()
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        group = numbered(rows)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield rows.slice(0, last).combine_chunks(), group[:last]
        held = rows.slice(last).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, numbered(rows)


def near_rows(group: np.ndarray, day: np.ndarray, days: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the rows of each row's group that are ``days`` apart at most; rows are ordered by group and day."""
    at = group * (int(day.max(initial=0)) - int(day.min(initial=0)) + days + 1) + day
    return np.searchsorted(at, at - days, "left"), np.searchsorted(at, at + days, "right")


def near_pairs(group: np.ndarray, day: np.ndarray, item: np.ndarray, days: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of a group, ``days`` apart at most, j of lower item; rows are ordered by group, day and item.

    About ``PAIRS`` at a time, all of a row i together and in order of j.
    """
    low, high = near_rows(group, day, days)
    count = high - low
    ends = np.cumsum(count)
    begin = 0
    while begin < len(item):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        n = count[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = np.arange(len(i)) + np.repeat(low[begin:end] - (np.cumsum(n) - n), n)
        keep = item[j] < item[i]
        yield i[keep], j[keep]
        begin = end


def firsts(i: np.ndarray) -> np.ndarray:
    """Places where a number of an ordered array stands first."""
    return np.flatnonzero(np.diff(i, prepend=-1)) if len(i) else np.zeros(0, np.int64)


class Texts:
    """Short texts as tables of bits: bounds of the ratios of pairs, and the ratios as ``SequenceMatcher`` has them.

    A text has a bit mask for each character, a bit a place; characters beyond the first ``_CODES`` - 1 that occur
    share one, which only raises a bound.  Ratios of texts of more than 64 characters, or with a shared one, are taken one by one.
    """

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.n = n = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(points.max(initial=0)) + 1, bool)
        seen[points] = True
        code = np.minimum(np.cumsum(seen) - 1, _CODES - 1)[points]
        row, place = np.repeat(np.arange(len(texts)), n), np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
        self.whole = n <= _WORD
        self.whole[row[code == _CODES - 1]] = False
        self.width = int(code.max(initial=0)) + 2
        pad = self.width - 1  # in no text
        short = place < _WORD
        row, place, code = (x[short] for x in (row, place, code))
        self.flat = np.zeros(len(texts) * self.width, np.uint64)
        np.bitwise_or.at(self.flat, row * self.width + code, np.uint64(1) << place.astype(np.uint64))
        self.steps = np.full((min(int(n.max(initial=0)), _WORD), len(texts)), pad)  # the characters of all texts at a place
        self.steps.ravel()[place * len(texts) + row] = code

    def bounds(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Upper bounds of the ratios of texts x and y (numbers): their longest common subsequence holds all matching blocks.

        A bit for each character of the one text, a step for each of the other.  A text of more than 64 characters is bounded by lengths.
        """
        base, v = x * self.width, np.full(len(x), ~np.uint64(0))
        for steps in self.steps[: min(int(self.n[y].max(initial=0)), _WORD)]:
            u = v & self.flat[base + steps[y]]
            v = (v + u) | (v - u)
        nx, ny = self.n[x], self.n[y]
        common = _WORD - np.bitwise_count(v).astype(np.int64)
        return 2.0 * np.where((nx > _WORD) | (ny > _WORD), np.minimum(nx, ny), common) / (nx + ny)

    def ratios(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The ratios of texts x and y (numbers)."""
        out = np.empty(len(x))
        whole = self.whole[x] & self.whole[y]
        for k in np.flatnonzero(~whole).tolist():
            a, b = self.texts[x[k]], self.texts[y[k]]
            out[k] = 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()
        some = np.flatnonzero(whole)
        for k in range(0, len(some), _REGIONS):
            at = some[k : k + _REGIONS]
            out[at] = 2.0 * self._matched(x[at], y[at]) / (self.n[x[at]] + self.n[y[at]])
        return out

    def _matched(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Characters in the matching blocks: the longest run that both hold, the first of equals, then those left and right of it."""
        alike = self.flat[y * self.width + self.steps[: int(self.n[x].max()), x]]  # for each place of x, where y has its character
        out = np.zeros(len(x), np.int64)
        pair, a0, a1, b0, b1 = np.arange(len(x)), np.zeros(len(x), np.int64), self.n[x], np.zeros(len(x), np.int64), self.n[y]
        while len(pair):
            order = np.argsort(a1 - a0, kind="stable")
            pair, a0, a1, b0, b1 = (c[order] for c in (pair, a0, a1, b0, b1))
            left = []
            for k in range(0, len(pair), _REGIONS):
                at = slice(k, k + _REGIONS)
                p, lo, hi, mlo, mhi = pair[at], a0[at], a1[at], b0[at], b1[at]
                size, i, j = _longest(alike, p, lo, hi, mlo, mhi)
                out += np.bincount(p, size, len(out)).astype(np.int64)
                for r in ((p, lo, i, mlo, j), (p, i + size, hi, j + size, mhi)):
                    more = (size > 0) & (r[2] > r[1]) & (r[4] > r[3])
                    left.append([c[more] for c in r])
            pair, a0, a1, b0, b1 = (np.concatenate(c) for c in zip(*left, strict=True))
        return out


def _longest(alike: np.ndarray, p: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and begin of the longest common run of each region; runs of twice the size are those that follow each other."""
    one, full = np.uint64(1), ~np.uint64(0)
    cols = np.arange(int((a1 - a0).max()))[:, None]
    ends = (full >> (_WORD - b1).astype(np.uint64)) & ~((one << b0.astype(np.uint64)) - one)
    runs = alike.ravel()[np.minimum(a0 + cols, len(alike) - 1) * alike.shape[1] + p] & np.where(cols < a1 - a0, ends, np.uint64(0))
    held = lambda runs: np.bitwise_or.reduce(runs, 0) != 0

    def followed(by: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
        out = np.empty_like(by)
        out[:m] = 0
        np.left_shift(first[:-m], np.uint64(m), out=out[m:])
        out[m:] &= by[m:]
        return out

    powers, best = [runs], runs
    size = held(runs).astype(np.int64)
    while (m := 1 << (len(powers) - 1)) < len(cols):
        runs = followed(runs, runs, m)
        more = held(runs)
        if not more.any():
            break
        powers.append(runs)
        best = np.where(more, runs, best)
        size[more] = 2 * m
    for m in (1 << k for k in range(len(powers) - 2, -1, -1)):
        runs = followed(powers[m.bit_length() - 1], best, m)
        more = held(runs) & (size > m)
        best = np.where(more, runs, best)
        size[more] += m
    i = (best != 0).argmax(0)
    bits = best[i, np.arange(len(p))]
    j = np.bitwise_count((bits & (~bits + one)) - one).astype(np.int64)
    return size, a0 + i - size + 1, j - size + 1


def best_ratios(texts: Texts, i: np.ndarray, j: np.ndarray, rows: int) -> np.ndarray:
    """The greatest ratio of each of so many rows over its pairs (i, j), or NaN; i is in order.

    Pairs are compared by falling bounds, and only while a bound is above the row's best: none that could be the best is left out.
    """
    out = np.full(rows, np.nan)
    bounds = texts.bounds(i, j)
    order = np.lexsort((-bounds, i))
    i, j, bounds = i[order], j[order], bounds[order]
    begin = firsts(i)
    rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
    many = 1
    low = 0
    while len(i):
        now = rank < low + many
        np.fmax.at(out, i[now], texts.ratios(i[now], j[now]))
        rest = ~now & ~(bounds <= out[i])
        i, j, bounds, rank = i[rest], j[rest], bounds[rest], rank[rest]
        low, many = low + many, 2 * many
    return out
