"""Helpers shared by the corpus operators: shared storage, text idioms, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import shared_dir

#: ASCII white space, the only separators that the corpus operators know.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are ``stored`` inside go at the end of the block, but those that were taken off the list it gives.

    For callers that store a result inside: nothing may read the others later.
    """
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for df in made:
            discard(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage (a lost executor costs only the tasks that read the
    files again) and computes what several later branches need just once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append(found)
    return found


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that no later plan reads; leaves files outside the shared folder alone."""
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    root = path_of(shared_dir(spark)).toUri().getPath()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = path_of(path)
        if target.getParent().toUri().getPath() == root:
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: A key is hot if it has more than this share of all rows, but not for fewer rows than LEAST_HOT.
HOT_SHARE, LEAST_HOT = 2048, 1000


def joined(rows: DataFrame, side: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each of the ``keys`` and in ``n`` how many of ``rows`` have it.

    Fewer than HOT_SHARE keys can have more than 1 / HOT_SHARE of all rows.
    Those are sent to where their rows are, so that no task gets all rows of a
    hot key; the rest is joined as usual. Null keys match nothing.
    """
    least = max(rows.count() // HOT_SHARE, LEAST_HOT)
    hot = side.where(F.col(n) > least)
    if hot.isEmpty():
        return rows.join(side, keys)
    there = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(side.where(F.col(n) <= least), keys)
    return there.unionByName(rest)


#: A sieve has about 8 bits a key and at most 2 ** WIDEST bits, in rows of 2 ** CELL_BITS.
WIDEST, CELL_BITS = 27, 15


class Sieve:
    """A bitmap of the ``key`` column of a table: tells for sure that a key is not in it.

    It is sent to all tasks, with 2 ** (WIDEST - CELL_BITS) rows of 4 kB at
    most. With more keys than it has room for, more rows pass for members; what
    is decided by comparing those with the keys stays right.
    """

    def __init__(self, keys: DataFrame):
        self.width = min(WIDEST, max(CELL_BITS, (8 * keys.count()).bit_length()))
        cell, at = self._place()
        cells = keys.select(cell.alias("cell"), at.alias("at")).groupBy("cell").agg(F.bitmap_construct_agg("at").alias("bits"))
        self.cells = stored(cells.withColumnsRenamed({"cell": "b_cell", "bits": "b_bits"}), "sieve")

    def _place(self) -> tuple[Column, Column]:
        h = F.pmod(F.xxhash64("key"), F.lit(1 << self.width))
        return F.shiftright(h, CELL_BITS), h.bitwiseAND(F.lit((1 << CELL_BITS) - 1))

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``rows`` whose ``key`` may be in the table, and those whose key is not. Their names don't begin with b_."""
        cell, at = self._place()
        told = rows.withColumn("b_at", at).join(F.broadcast(self.cells), cell == F.col("b_cell"), "left")
        byte = F.conv(F.hex(F.expr("substring(b_bits, cast(b_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
        told = told.withColumn("b_maybe", F.coalesce(F.getbit(byte, (F.col("b_at") % 8).cast("int")) == 1, F.lit(False)))
        return tuple(told.where(c).select(*rows.columns) for c in ("b_maybe", "not b_maybe"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Stored rows of ``key``, a number of their own, and ``whole``, the row of ``docs`` as a struct, so that no name of it can clash."""
    return stored(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("whole")), name)


def field(name: str) -> Column:
    """A column of ``docs`` in ``numbered`` rows, whatever its name holds."""
    return F.col("whole").getField(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sampled(docs: DataFrame, rows: int, salt: int = 0) -> DataFrame:
    """About ``rows`` rows of ``docs`` that have a ``doc_id``, drawn by a hash of it; all rows where there are no more.

    Each task picks its own rows, so nothing gathers in one; reruns draw the same ids.
    """
    n = docs.count()
    if n <= rows:
        return docs
    chance = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 40)) < int(rows / n * (1 << 40))
    return docs.where(F.col("doc_id").isNotNull() & chance)
