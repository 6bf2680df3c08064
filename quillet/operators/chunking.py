"""Cutting documents into chunks within a token budget (CHK-1 to CHK-7, CHK-9)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import cjk_count, fold, sentences, tokens
from .blocks import cut
from .parsing import markdown_sections

STRATEGIES = ("RECURSIVE", "TOKEN", "SLIDING_WINDOW", "HEADING", "HYBRID", "PARENT_CHILD", "SEMANTIC")
_CHUNKS = "chunk_index int, chunk_id string, parent_id string, section string, text string, tokens int"
_NAMES = [c.split()[0] for c in _CHUNKS.split(", ")]
#: Characters of chunks that a task holds before it hands them on.
_FLUSH = 1 << 22


@dataclass(frozen=True)
class Budget:
    """Sizes in tokens."""

    most: int = 512
    overlap: int = 64
    least: int = 32
    parent: int = 2_048
    alike: float = 0.82
    stride: int = 256


def count(text: str) -> int:
    wide = cjk_count(text)
    return tokens(wide, len(text) - wide)


class Units:
    """Pieces of a text; the size of any run of them, joined by blanks, from running sums."""

    def __init__(self, parts: list[str]) -> None:
        wide = [cjk_count(p) for p in parts]
        self.parts = parts
        self.wide = [0, *accumulate(wide)]
        self.other = [0, *accumulate(len(p) - w for p, w in zip(parts, wide, strict=True))]

    def size(self, a: int, b: int) -> int:
        return tokens(self.wide[b] - self.wide[a], self.other[b] - self.other[a] + max(0, b - a - 1))

    def end(self, a: int, budget: int) -> int:
        """Where the longest run from ``a`` within the budget ends; one piece at least."""
        b = a + 1
        while b < len(self.parts) and self.size(a, b + 1) <= budget:
            b += 1
        return b

    def text(self, a: int, b: int) -> str:
        return " ".join(self.parts[a:b])


def packed(parts: list[str], most: int, overlap: int) -> list[str]:
    """Runs within the budget; each begins with the end of the one before, as far as the overlap allows."""
    u, out, a = Units(parts), [], 0
    while a < len(parts):
        b = u.end(a, most)
        out.append(u.text(a, b))
        if b == len(parts):
            break
        back = b
        while back > a and u.size(back - 1, b) <= overlap:
            back -= 1
        a = back if a < back else b
    return out


def slid(words: list[str], most: int, stride: int) -> list[str]:
    u, out, a = Units(words), [], 0
    while a < len(words):
        b = u.end(a, most)
        out.append(u.text(a, b))
        if b == len(words):
            break
        step = a
        while step < b and u.size(a, step + 1) <= stride:
            step += 1
        a = max(step, a + 1)
    return out


def recursive(text: str, most: int, overlap: int) -> list[str]:
    """Paragraphs, cut into sentences and these into words only where too long, then packed."""
    parts: list[str] = []
    for paragraph in filter(None, map(str.strip, _paragraphs(text))):
        if count(paragraph) <= most:
            parts.append(paragraph)
            continue
        for s in sentences(paragraph):
            parts.extend([s] if count(s) <= most else s.split())
    return packed(parts, most, overlap)


def _paragraphs(text: str) -> list[str]:
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.strip():
            out[-1].append(line)
        else:
            out.append([])
    return ["\n".join(p) for p in out]


def tail_joined(chunks: list[str], least: int, most: int) -> list[str]:
    if len(chunks) > 1 and count(chunks[-1]) < least:
        both = f"{chunks[-2]} {chunks[-1]}"
        if count(both) <= most:
            return [*chunks[:-2], both]
    return chunks


@lru_cache(1 << 18)
def _bucket(gram: str) -> tuple[int, int]:
    digest = hashlib.blake2b(gram.encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big"), 1 if digest[4] & 1 else -1


def hashed(text: str, dims: int = 64) -> np.ndarray:
    """Unit vector of hashed 3- and 4-grams of the folded text (EMB-1); zeros for no text."""
    v, bare = [0.0] * dims, fold(text)
    padded = f" {bare} "
    for size in (3, 4) if bare else ():
        for k in range(len(padded) - size + 1):
            at, sign = _bucket(padded[k : k + size])
            v[at % dims] += sign
    return _unit(np.array(v))


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.sign(v) * np.log1p(np.abs(v))
    norm = np.linalg.norm(v)
    return v / norm if norm >= 1e-12 else v


#: Characters whose grams are hashed together.
_HASHED_CHARS = 1_000_000


def hashed_all(texts: list[str | None], dims: int = 64) -> Iterator[np.ndarray]:
    """``hashed`` of each text: grams are told apart as numbers, so that each different one of many texts is hashed once."""
    held: list[str] = []
    size = 0
    for t in texts:
        bare = fold(t)
        held.append(f" {bare} " if bare else "")
        size += len(held[-1])
        if size >= _HASHED_CHARS:
            yield from _hashed_together(held, dims)
            held, size = [], 0
    yield from _hashed_together(held, dims)


def _hashed_together(padded: list[str], dims: int) -> Iterator[np.ndarray]:
    whole = "".join(padded)
    chars, code = np.unique(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    bits = np.uint64(max(1, int(len(chars)).bit_length()))  # four places of 16 bits at most, for less than 65,536 different characters
    if bits > 16:
        middle = len(padded) // 2
        for part in (padded[:middle], padded[middle:]) if middle else ():
            yield from _hashed_together(part, dims)
        if not middle:
            yield hashed(padded[0], dims)
        return
    code = code.astype(np.uint64)
    lens = np.fromiter(map(len, padded), np.int64, len(padded))
    row, end = np.repeat(np.arange(len(padded)), lens), np.repeat(np.cumsum(lens), lens)
    v = np.zeros(len(padded) * dims)
    for size in (3, 4):
        at = np.flatnonzero(np.arange(len(code)) + size <= end)
        key = np.zeros(len(at), np.uint64)
        for k in range(size):
            key = (key << bits) | code[at + k]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        found = np.array([_bucket(whole[i : i + size]) for i in at[first].tolist()], np.int64).reshape(-1, 2)
        v += np.bincount(row[at] * dims + found[which, 0] % dims, found[which, 1], len(v))
    yield from map(_unit, v.reshape(-1, dims))


def semantic(text: str, b: Budget) -> list[str]:
    """Sentences join the group before while they resemble its mean and fit."""
    groups: list[tuple[str, np.ndarray]] = []
    for s in sentences(text):
        v = hashed(s)
        if groups:
            held, mean = groups[-1]
            scale = np.linalg.norm(mean) * np.linalg.norm(v)
            if scale and float(mean @ v) / scale >= b.alike and count(f"{held} {s}") <= b.most:
                groups[-1] = (f"{held} {s}", mean + v)
                continue
        groups.append((s, v))
    return [piece for t, _ in groups for piece in ([t] if count(t) <= b.most else packed(t.split(), b.most, b.overlap))]


def split(text: str | None, strategy: str, b: Budget) -> list[dict]:
    """Chunks of one document: parent's place or -1, heading path, text, tokens."""
    text = text or ""
    row = lambda t, section="", parent=-1: {"parent": parent, "section": section, "text": t, "tokens": count(t)}
    if strategy == "PARENT_CHILD":
        out: list[dict] = []
        for whole in recursive(text, b.parent, 0):
            out.append(row(whole))
            at = len(out) - 1
            out.extend(row(t, parent=at) for t in recursive(whole, b.most, b.overlap))
        return out
    if strategy in ("HEADING", "HYBRID"):
        out = []
        for s in markdown_sections(text):
            path = " > ".join(s["path"])
            if strategy == "HYBRID":
                parts = recursive(s["text"], b.most, b.overlap)
            else:
                parts = [s["text"]] if count(s["text"]) <= b.most else packed(s["text"].split(), b.most, b.overlap)
            out.extend(row(t, path) for t in parts if t.strip())
        return out
    parts = {
        "RECURSIVE": lambda: tail_joined(recursive(text, b.most, b.overlap), b.least, b.most),
        "TOKEN": lambda: packed(text.split(), b.most, b.overlap),
        "SLIDING_WINDOW": lambda: slid(text.split(), b.most, b.stride),
        "SEMANTIC": lambda: semantic(text, b),
    }[strategy]()
    return [row(t) for t in parts]


def chunk(df: DataFrame, strategy: str = "RECURSIVE", budget: Budget = Budget(), key: str = "doc_id", col: str = "text") -> DataFrame:
    """(key, chunk_index, chunk_id, parent_id, section, text, tokens); documents are cut one by one, without a shuffle.

    A task holds the chunks of one document, and some megabytes that it hands on next, however many rows a batch has.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "PARENT_CHILD" and budget.parent <= budget.most:
        raise ValueError("a parent must be larger than a child")

    def name(own: str | None, at: int, text: str) -> str:
        return hashlib.sha256("|".join([*([] if own is None else [own]), str(at), text]).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, size = [], [], 0
            for i in range(batch.num_rows):  # one text at a time, handed on by some megabytes
                own = batch["_own"][i].as_py()
                parts = split(batch["_text"][i].as_py(), strategy, budget)
                names = [name(own, at, c["text"]) for at, c in enumerate(parts)]
                for at, c in enumerate(parts):
                    rows.append(i)
                    held.append((at, names[at], names[c["parent"]] if c["parent"] >= 0 else None, c["section"], c["text"], c["tokens"]))
                    size += len(c["text"]) + 100
                    if size > _FLUSH:
                        yield _batch(batch, rows, held, schema)
                        rows, held, size = [], [], 0
            if rows:
                yield _batch(batch, rows, held, schema)

    out = f"{key} {df.schema[key].dataType.simpleString()}, {_CHUNKS}"
    schema = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
    return df.select(key, F.col(key).cast("string").alias("_own"), F.col(col).alias("_text")).mapInArrow(run, out)


def _batch(batch: pa.RecordBatch, rows: list[int], held: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], [batch.schema.names[0], *_NAMES])


def check_chunks(chunks: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Chunks whose parent is missing, or that are over their budget (CHK-9)."""
    chunks = cut(chunks.select("chunk_id", "parent_id", "tokens"))  # read three times
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.lit(True).alias("_there")).distinct()
    used = chunks.select(F.col("parent_id").alias("chunk_id")).filter("chunk_id IS NOT NULL").distinct().withColumn("_is_parent", F.lit(True))
    met = chunks.join(parents, "parent_id", "left").join(used, "chunk_id", "left")
    limit = F.when(F.col("_is_parent"), budget.parent).otherwise(budget.most)
    why = F.when(F.col("parent_id").isNotNull() & F.col("_there").isNull(), "DANGLING_PARENT").when(F.col("tokens") > limit, "OVER_BUDGET")
    return met.withColumn("violation", why).filter("violation IS NOT NULL").select("chunk_id", "violation")
