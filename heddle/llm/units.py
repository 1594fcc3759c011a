"""Comparison units: groups that share a key, cut into pairs of chunks where they are large."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import HOT_SHARE, stored

CHUNK = 4096


def dealt(rows: DataFrame, keys: list[str], member: str, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with their units (i, j) added, dealt out and sorted by (keys, i, j).

    Up to ``chunk`` rows of a key are one unit, (0, 0). A key with more is cut
    into chunks by a hash of ``member``; chunks i <= j meet in unit (i, j). Any
    two rows of a key share a unit, and a unit holds about two chunks at most.
    """
    crowded = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    crowded = stored(crowded.select(*keys, "n", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "crowded")
    # The few keys with a great part of all rows are told to every task, so their rows aren't gathered to be dealt out.
    least = max(rows.count() // HOT_SHARE, chunk)
    hot = crowded.where(F.col("n") > least)
    if hot.isEmpty():
        told = rows.join(crowded.drop("n"), keys, "left")
    else:
        there = rows.join(F.broadcast(hot.drop("n")), keys)
        told = there.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(crowded.where(F.col("n") <= least).drop("n"), keys, "left"))
    mine = F.pmod(F.xxhash64(member), F.col("chunks")).cast("int")
    units = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    )
    found = told.withColumn("u", F.explode(units)).select(*keys, "u.i", "u.j", *[c for c in rows.columns if c not in keys])
    return found.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """(key, other columns) of each run of equal first ``n_keys`` integer columns with two rows or more, over batch ends too."""
    held: list[pa.RecordBatch] = []
    unit: tuple = ()

    def closed():
        if sum(x.num_rows for x in held) > 1:
            yield unit, [pa.concat_arrays([x.column(c) for x in held]) for c in range(n_keys, held[0].num_columns)]

    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in range(n_keys)]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], b.num_rows)
        first = tuple(int(k[0]) for k in keys)
        if held and first != unit:
            yield from closed()
            held = []
        for s, e in zip(starts[(ends - starts > 1) | (starts == 0) | (ends == b.num_rows)].tolist(), ends[(ends - starts > 1) | (starts == 0) | (ends == b.num_rows)].tolist()):
            if s == 0 and held or e == b.num_rows:
                if s and held:
                    yield from closed()
                    held = []
                unit = tuple(int(k[s]) for k in keys)
                held.append(b.slice(s, e - s))
            elif e - s > 1:
                yield tuple(int(k[s]) for k in keys), [b.column(c).slice(s, e - s) for c in range(n_keys, b.num_columns)]
            if s == 0 and e < b.num_rows and held:
                yield from closed()
                held = []
    if held:
        yield from closed()


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of 0 .. n - 1; ``linked(i, others)`` has the positions in ``others`` of those linked to i."""
    rest, links, queue = np.arange(1, n), [], [0]
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        at = queue.pop()
        hit = linked(at, rest)
        if len(hit):
            found = rest[hit].tolist()
            links += [(at, x) for x in found]
            queue += found
            rest = np.delete(rest, hit)
    return links
