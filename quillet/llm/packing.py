"""Variable-capacity best-fit packing (operator 1).

Documents are packed into training sequences of several permitted lengths.
Pieces are placed longest first into the open sequence with the least room that
still holds them.  Where none does, one is opened, and the permitted lengths
compete: for each, the sequence is filled in thought with the longest pieces
that are still to come, is shrunk to the shortest length that holds them, and the
length with the least cost per token that it would hold is opened.  A long
sequence costs more per token (attention), a short one wastes more of its room;
which wins depends on the pieces that are left.  At the end each sequence shrinks
to the shortest permitted length that holds its contents.  Every shard is also
packed with the shortest fitting and the longest length always opened, and the
cheapest packing stays.

Scale: only (doc_id, number of tokens) moves.  Pieces are dealt round-robin into
shards of about ``SHARD_PIECES``; each shard is one task of bounded memory, so
neither one hot key nor the size of the corpus matters, and the loss at the
shards' edges is under one sequence of each length in tens of thousands.
Spark's round-robin sorts before it deals and each shard sorts again, so a
recomputed task gives the same sequences.

The length of a document is its number of words plus one end-of-text mark.  A
document longer than the longest permitted length is cut into pieces of that
length and a rest; nothing is dropped.

Edge cases: a null or empty text is one token (the end mark); repeated rows are
packed as often as they come; a null doc_id is packed like any other; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, text_or_empty

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)
SHARD_PIECES = 50_000
SCHEMA = (
    "doc_id long, n_tokens long, piece_no int, piece_tokens int, bin_id long, bin_offset int, bin_tokens int, capacity int"
)


def training_cost(length: int) -> float:
    """Relative cost of one sequence: linear layers plus attention."""
    return length * (1 + length / 8192)


class _Left:
    """The pieces still to be placed, by size."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count = Counter(sizes)
        self.sizes = sum(1 << size for size in self.count)  # bit n is set if a piece of size n is left

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.sizes ^= 1 << size

    def fill(self, room: int) -> int:
        """Tokens that the longest pieces that fit, one after the other, put into ``room``."""
        filled, below = 0, room + 1
        while room and (fitting := self.sizes & ((1 << min(room + 1, below)) - 1)):
            size = fitting.bit_length() - 1
            n = min(self.count[size], room // size)
            filled, room, below = filled + n * size, room - n * size, size
        return filled


def _fit(sizes: Sequence[int], lengths: Sequence[int], open_length: Callable[[int, _Left], int]) -> tuple[list[int], list[int]]:
    """The bin of each piece and the contents of each bin; sizes descend."""
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by what still fits
    rooms = 0  # bit r is set if room[r] has a bin
    where, contents = [], []
    left = _Left(sizes)
    for size in sizes:
        left.take(size)
        fitting = rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                rooms ^= 1 << r
        else:
            b, r = len(contents), open_length(size, left)
            contents.append(0)
        contents[b] += size
        where.append(b)
        if r > size:
            room[r - size].append(b)
            rooms |= 1 << (r - size)
    return where, contents


def pack_shard(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = training_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin of each piece (sizes descending), contents and final length of each bin."""
    lengths = sorted(lengths)

    def shrunk(n: int) -> int:
        return next(c for c in lengths if c >= n)

    def least_cost(size: int, left: _Left) -> int:
        held = {c: size + left.fill(c - size) for c in lengths if c >= size}
        return min(held, key=lambda c: (cost(shrunk(held[c])) / held[c], c))

    best = None
    for policy in (least_cost, lambda size, _: shrunk(size), lambda *_: lengths[-1]):
        where, contents = _fit(sizes, lengths, policy)
        final = [shrunk(n) for n in contents]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, where, contents, final)
    return best[1:]


def _shards(lengths: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        if not table.num_rows:
            return
        size = table["piece_tokens"].to_numpy()
        ids = table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((table["piece_no"].to_numpy(), ids, -size))
        table = table.take(order)
        where, contents, final = pack_shard(size[order].tolist(), lengths)
        used, offsets = [0] * len(contents), []
        for b, n in zip(where, size[order].tolist(), strict=True):
            offsets.append(used[b])
            used[b] += n
        where = np.array(where)
        first = TaskContext.get().partitionId() << 32
        for name, values, kind in (
            ("bin_id", where + first, pa.int64()),
            ("bin_offset", offsets, pa.int32()),
            ("bin_tokens", np.array(contents)[where], pa.int32()),
            ("capacity", np.array(final)[where], pa.int32()),
        ):
            table = table.append_column(name, pa.array(values, kind))
        yield from table.to_batches(max_chunksize=10_000)

    return pack


def lengths_of(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens: words of the whole text and one end mark."""
    return docs.select("doc_id", (F.regexp_count(text_or_empty(), F.lit(WORD)) + 1).cast("long").alias("n_tokens"))


def pack(sized: DataFrame, lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Place every row of (doc_id, n_tokens): one row per piece, with its sequence and offset."""
    most = max(lengths)
    rows = cut(sized.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens"))
    pieces = rows.select(
        "doc_id",
        "n_tokens",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / most), F.lit(1)).cast("int") - 1)).alias("piece_no"),
    ).withColumn("piece_tokens", F.least(F.lit(most), F.col("n_tokens") - F.col("piece_no").cast("long") * most).cast("int"))
    total = rows.agg(F.sum(F.ceil(F.col("n_tokens") / most))).first()[0] or 1
    shards = max(1, -(-int(total) // shard_pieces))
    return pieces.repartition(shards).mapInArrow(_shards(tuple(sorted(lengths))), SCHEMA)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    return pack(lengths_of(docs), **options)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: its length, contents and the pieces in order."""
    piece = F.struct("bin_offset", "doc_id", "piece_no", "piece_tokens")
    return placed.groupBy("bin_id", "capacity", "bin_tokens").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
