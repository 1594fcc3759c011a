"""Exact de-duplication over an extendible-hash index on shared files.

Texts are equal when they are identical after ASCII white space is deleted.
The index is built like an extendible hash file:

* every row gets a 64-bit key of its squeezed text. Rows are counted per key
  before they move, so a group with a third of all rows is one row from each
  task;
* the *directory* starts at the depth that the number of keys asks for and is
  doubled, one leading bit of the key at a time, until no bucket has more than
  ``capacity`` keys. There is no limit but the key's own bits. A bucket that
  fits keeps its shorter local depth, and several slots then point to it;
* keys find their bucket through their slot; owner tasks take disjoint ranges
  of (bucket, key) and write the index, a chain for each key;
* a chain of one row is done. Of all others the *bytes* are compared, and only
  their texts move: a bitmap of their keys, at most 16 MB whatever the input,
  tells each task which rows to send, and of equal texts it sends one. Where
  different bytes share a key, the chain is resolved by the bytes themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import Sieve, joined, squeezed, stored, text_of

CAPACITY = 4096


def _key(bare: Column, key_bits: int) -> Column:
    return F.xxhash64(bare).bitwiseAND(F.lit(-1 << (64 - key_bits)))


def _keyed(docs: DataFrame, key_bits: int) -> DataFrame:
    bare = squeezed(text_of())
    return docs.select("doc_id", F.char_length(text_of()).alias("n_points"), _key(bare, key_bits).alias("key"), bare.alias("bare"))


def _sha(bare: Column) -> Column:
    return F.unhex(F.sha2(bare.cast("binary"), 256))


def slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, key_bits: int = 64, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket) for every slot in use, from distinct ``key`` values, and the directory's depth.

    A bucket is named by the first of its slots. It has at most ``capacity``
    keys, or one key where ``capacity`` is less.
    """
    depth = min(key_bits, max(0, (keys.count() // capacity).bit_length() - 1))
    left, levels = keys.select("key"), []
    while True:
        held = stored(left.groupBy(slot(F.col("key"), depth).alias("prefix")).agg(F.count("*").alias("n")), "exact-level")
        over = held.where(F.col("n") > (capacity if depth < key_bits else F.col("n"))).select("prefix")
        levels.append((depth, held.where(F.col("n") <= capacity) if depth < key_bits else held))
        if over.isEmpty():
            break
        left = left.join(over, slot(F.col("key"), depth) == F.col("prefix"), "left_semi")
        depth += 1
    found = None
    for at, fitting in levels:
        first = F.shiftleft("prefix", depth - at)
        part = fitting.select(F.explode(F.sequence(first, first + (1 << (depth - at)) - 1)).alias("slot"), first.alias("bucket"))
        found = part if found is None else found.unionByName(part)
    return stored(found, "exact-directory"), depth


def _best() -> Column:
    """Smallest is the row that stays: most code points, smallest id, nulls last."""
    return F.min(F.struct((-F.col("n_points")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))


def _chains(docs: DataFrame, key_bits: int, capacity: int) -> tuple[DataFrame, Sieve]:
    """All rows with their group (doc_id, n_points, sha, row, best, n), and the keys of more than one row."""
    keyed = _keyed(docs, key_bits)
    entries = stored(keyed.select("doc_id", "n_points", "key", _sha(F.col("bare")).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-entries")
    keys = stored(entries.groupBy("key").agg(_best().alias("best"), F.count("*").alias("n")), "exact-keys")
    slots, depth = directory(keys, key_bits, capacity)
    index = keys.join(slots, slot(F.col("key"), depth) == F.col("slot")).select("bucket", "key", "n", "best")
    index = stored(index.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "exact-index")

    suspects = Sieve(index.where("n > 1"))
    # Of one text a task sends one row, however many copies it holds.
    texts = suspects.split(keyed)[0].withColumn("slot", slot(F.col("key"), depth))
    compared = texts.groupBy("slot", "key").agg(F.min("bare").alias("low"), F.max("bare").alias("high"))
    mixed = stored(compared.where("low <> high").select("key"), "exact-mixed")
    chains = index.select("key", "n", "best")
    told = ["doc_id", "n_points", "sha", "row", "best", "n"]
    if mixed.isEmpty():
        return joined(entries, chains, ["key"], "n").select(*told), suspects
    clean = joined(entries.join(mixed, "key", "left_anti"), chains.join(mixed, "key", "left_anti"), ["key"], "n")
    rows = suspects.split(keyed)[0].join(mixed, "key", "left_semi").withColumns({"row": F.monotonically_increasing_id(), "sha": _sha(F.col("bare"))})
    rows = stored(rows, "exact-collisions")
    by_text = rows.groupBy("key", "bare").agg(_best().alias("best"), F.count("*").alias("n"))
    return clean.select(*told).unionByName(joined(rows, by_text, ["key", "bare"], "n").select(*told)), suspects


def exact_groups(docs: DataFrame, *, key_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty texts form one group. Of equal texts
    the row with the most code points stays, then the smallest doc_id (null ids
    last); of rows that repeat an id and a text exactly one stays. An empty
    table gives no rows; other columns of ``docs`` are not read.

    ``key_bits`` and ``capacity`` can be lowered (tests do) to force collisions
    and doublings; the result doesn't depend on them.
    """
    return _chains(docs, key_bits, capacity)[0].select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each group of equal texts.

    The row that stays is the one that ``exact_groups`` names; of rows that
    agree in id, text and length one stays, any. Null texts count as empty.
    Other rows and all columns, whatever their names, are untouched: no row
    whose key is its own is moved. An empty table gives no rows.
    """
    chains, suspects = _chains(docs.select("doc_id", "text"), 64, CAPACITY)
    stay = chains.where("row = best.row").select(F.col("doc_id").alias("s_id"), F.col("n_points").alias("s_points"), F.col("sha").alias("s_sha"))
    text = text_of("whole.text")
    rows = docs.select(F.struct("*").alias("whole")).withColumn("key", _key(squeezed(text), 64))
    maybe, alone = suspects.split(rows)
    maybe = maybe.withColumns({"sha": _sha(squeezed(text)), "points": F.char_length(text)})
    same = (F.col("sha") == F.col("s_sha")) & F.col("whole.doc_id").eqNullSafe(F.col("s_id")) & (F.col("points") == F.col("s_points"))
    best = maybe.join(stay, same, "left_semi").groupBy("sha").agg(F.first("whole").alias("whole"))
    return alone.select("whole.*").unionByName(best.select("whole.*"))
