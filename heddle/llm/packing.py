"""Best-fit-decreasing packing of tokenised documents into fixed-size sequences.

Sizes are whole numbers up to the capacity, so best-fit decreasing never needs
the documents one by one: all pieces of one size are placed together. A segment
tree over remaining capacities finds the tightest open bins that still fit in
logarithmic time; a run of equal bins with equal room moves as one range. The
plan is that of best-fit decreasing over all pieces of the table, whatever
their number, yet is made from at most ``capacity`` counts. Pieces then find
their place by their rank among pieces of their size; ranks come from windows
over (size, hash bucket) and the totals of the buckets; there is a bucket for each
ROWS pieces of the table, so a size with a third of them has windows as small
as any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import stored, text_of
from heddle.llm.tokens import encoder

CAPACITY, END_ID = 4096, 1
#: About how many pieces share a window of ranks, at most, and the fewest buckets.
ROWS, BUCKETS = 100_000, 128
_RANK_BITS = 44


class OpenBins:
    """Ranges of equal bins by remaining capacity, under a segment tree that tells which capacities are in use."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int) -> None:
        at = room + self.leaves
        self.tree[at] = bool(self.ranges[room])
        while at > 1:
            at >>= 1
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.ranges[room].append((first, count))
            self._set(room)

    def tightest(self, size: int) -> int:
        """The smallest remaining capacity in use of at least ``size``; 0 if there is none."""
        at = size + self.leaves
        if self.tree[at]:
            return size
        while at > 1 and not (at % 2 == 0 and self.tree[at + 1]):
            at >>= 1
        if at <= 1:
            return 0
        at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, room: int) -> tuple[int, int]:
        found = self.ranges[room].pop()
        self._set(room)
        return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Moves (size, first rank, first bin, pieces per bin, offset) of best-fit decreasing, and the number of bins.

    A move places the pieces of its size from its first rank up to the next
    move's, ``per bin`` to each bin in turn.
    """
    bins, moves, used = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = bins.tightest(size)
            if room:
                first, count = bins.take(room)
            else:
                room, first = capacity, used
                count = -(-left // (capacity // size))
                used += count
            per = room // size
            moves.append((size, rank, first, per, capacity - room))
            full, rest = divmod(min(left, count * per), per)
            bins.put(room - per * size, first, full)
            if rest:
                bins.put(room - rest * size, first + full, 1)
            done = full + bool(rest)
            bins.put(room, first + done, count - done)
            placed = full * per + rest
            left, rank = left - placed, rank + placed
    return moves, used


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each row's ids and the end id, cut every ``capacity`` ids."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(vocabulary).encode, 4 * capacity
        for b in batches:
            which, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text) + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    which.append(i)
                    found.append((at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one id. Repeated rows are packed as
    often as they occur; rows that agree in id and piece are interchangeable.
    An empty table gives no rows; other columns are ignored.
    """
    cut = stored(pieces(docs, vocabulary, capacity, end_id), "pack-pieces")
    buckets = max(BUCKETS, cut.count() // ROWS)  # from the files' footers
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    moves, _ = plan(counts, capacity)
    table = np.array(sorted(moves), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << _RANK_BITS) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            move = table[np.searchsorted(keys, (size << _RANK_BITS) + rank, "right") - 1]
            bins, at = np.divmod(rank - move[:, 1], move[:, 3])
            cols = [b.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(move[:, 2] + bins), pa.array(move[:, 4] + at * size)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("at", F.row_number().over(inside) - 1).join(firsts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).cast("long").alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
