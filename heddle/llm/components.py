"""Connected components of links between integer nodes, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import discard, joined, stored


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the component's smallest node.

    Alternates large-star and small-star steps until the links are stars: a
    number of rounds logarithmic in the longest path. Each round moves every
    link a constant number of times, combines minima before the shuffle, joins the
    links of a hub where they are, and is written to the shared folder. Links with
    a null end and loops are no links; no links give no rows.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        least = stored(least, "links-least")
        large = stored(joined(both.where("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links-large")
        closest = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "links-closest")
        small = joined(large, closest, ["a"], "n").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        new = stored(small.select("l.*").where("a <> b").distinct(), "links")
        for old in (now, least, large, closest):
            discard(old)
        now, last = new, mark
        mark = _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
