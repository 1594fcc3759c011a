"""Consistent-hash placement of partitions on nodes, on the driver and as DataFrames."""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.errors import DatasetError

MOST_VNODES = 400
MB_PER_VNODE = 100


@dataclass(frozen=True)
class Node:
    uri: str
    cache_bytes: int

    @property
    def vnodes(self) -> int:
        return vnodes(self.cache_bytes)


def vnodes(cache_bytes: int, most: int = MOST_VNODES) -> int:
    """Ring points of a node: its cache in whole MB by 100, between 1 and ``most``."""
    return max(1, min(most, cache_bytes // (1 << 20) // MB_PER_VNODE))


def crc32(text: str) -> int:
    return zlib.crc32(text.encode())


class Ring:
    """An ordered ring of CRC-32 points ``<uri>_<i>``; the first node to claim a point keeps it."""

    def __init__(self, nodes: list[Node]):
        self.points: dict[int, str] = {}
        for n in nodes:
            self.add(n)

    def add(self, node: Node) -> None:
        for i in range(node.vnodes):
            self.points.setdefault(crc32(f"{node.uri}_{i}"), node.uri)
        self._sorted = sorted(self.points)

    def remove(self, node: Node) -> None:
        self.points = {k: v for k, v in self.points.items() if v != node.uri}
        self._sorted = sorted(self.points)

    def locate(self, key: str | int) -> str:
        """The node of the first point at or after the key's hash, or of the first point of all."""
        if not self.points:
            raise DatasetError("the ring has no node")
        at = bisect.bisect_left(self._sorted, crc32(key) if isinstance(key, str) else key)
        return self.points[self._sorted[at % len(self._sorted)]]


def ring_points(nodes: DataFrame) -> DataFrame:
    """(point, uri) from nodes (pos, uri, cache_bytes); on a collision the node that comes first keeps the point."""
    n = F.greatest(F.lit(1), F.least(F.lit(MOST_VNODES), F.floor(F.floor(F.col("cache_bytes") / (1 << 20)) / MB_PER_VNODE)))
    points = nodes.select("pos", "uri", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    points = points.withColumn("point", F.crc32(F.concat_ws("_", "uri", F.col("i").cast("string")).cast("binary")))
    first = Window.partitionBy("point").orderBy("pos", "i")
    return points.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("point", "uri")


def ring_ranges(points: DataFrame) -> DataFrame:
    """(low, high, uri): key hashes in (low, high] belong to ``uri``; the wrap-around is a range of its own.

    A ring has at most MOST_VNODES points for each node, so one sort of them is small.
    """
    w = Window.orderBy("point")
    ranges = points.select(F.coalesce(F.lag("point").over(w), F.lit(-1)).alias("low"), F.col("point").alias("high"), "uri")
    wrap = points.agg(F.max("point").alias("low"), F.min_by("uri", "point").alias("uri")).select("low", F.lit((1 << 32) - 1).alias("high"), "uri")
    return ranges.unionByName(wrap)


#: Hash space slices that turn the range lookup into an equi-join.
SLICES = 4096
_SLICE_BITS = 20


def assign(keys: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """``keys`` with the ``uri`` that each key's hash belongs to.

    The 32-bit hash space is cut into slices; a range is listed under each
    slice that it meets, so keys find it by an equi-join on the slice, without
    a nested loop. The ring side is bounded by its points plus SLICES rows. A
    ring without nodes is an error.
    """
    if nodes.isEmpty():
        raise DatasetError("the ring has no node")
    ranges = ring_ranges(ring_points(nodes))
    slices = ranges.withColumn("slice", F.explode(F.sequence(F.shiftright(F.col("low") + 1, _SLICE_BITS).cast("int"), F.shiftright("high", _SLICE_BITS).cast("int"))))
    hashed = keys.withColumn("key_hash", F.crc32(F.col(key).cast("string").cast("binary"))).withColumn("slice", F.shiftright("key_hash", _SLICE_BITS).cast("int"))
    inside: Column = (F.col("key_hash") > F.col("low")) & (F.col("key_hash") <= F.col("high"))
    return hashed.join(F.broadcast(slices), "slice").where(inside).drop("slice", "low", "high")


def distribution(assigned: DataFrame) -> DataFrame:
    """(uri, n, percent): keys of each node and their share in whole percent."""
    per = assigned.groupBy("uri").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return per.select("uri", "n", F.floor(100 * F.col("n") / total).cast("int").alias("percent"))


def moved(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(uri, key): what each old node has to let go, one row a key."""
    o, n = old.select(F.col(key), F.col("uri")), new.select(F.col(key).alias("__k"), F.col("uri").alias("now"))
    return o.join(n, F.col(key) == F.col("__k")).where("uri <> now").select("uri", key)
