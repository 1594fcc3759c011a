"""SimHash near-duplicates with pigeonring filtering.

64-bit fingerprints link at DISTANCE or fewer differing bits. The 64 bits are a
ring of RING segments. By the pigeonring principle two linked fingerprints have
a segment from which every chain of l consecutive segments differs in at most
l * DISTANCE / RING bits: 0, 1, 2, 3 for chains of 1 to 4 segments. So

* the first segment of the chain matches exactly;
* the next two segments together differ in at most 2 bits, at most 1 of them in
  the first. Cut into halves a1 a2 | b1 b2, either a1 and a2 match, or one of
  the a and one of the b do.

Five starts times five such pairs of halves give 25 keys of about 26 bits; any
two linked fingerprints share one. Only those that share a key are compared,
first chain by chain, then in full. Equal fingerprints are one from the start.

A key with many fingerprints is dealt out as pairs of chunks, so no task holds
more than two chunks; each gives the links of a spanning forest, never all
pairs, and no link between different components of a chunk pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import Sieve, field, joined, numbered, stored
from heddle.llm.components import components
from heddle.llm.units import CHUNK, dealt, forest, groups

DISTANCE, RING, SHINGLE, SEED = 4, 5, 4, 42
WIDTHS = (13, 13, 13, 13, 12)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of UTF-8 ``text``: 0 without words; one shingle if it has fewer words than that."""
    words = text.lower().split()  # both for ASCII only
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    many = n - shingle + 1
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, many)
    ones = np.zeros(64, np.int64)
    for at in range(0, many, 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > many, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, then ``fp``, the fingerprint as a signed 64-bit integer; null texts are empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *kept, texts = b.columns
            fps = np.fromiter((fingerprint((t or "").encode(), shingle) for t in texts.to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(of, T.StructType([*[rows.schema[c] for c in keep], T.StructField("fp", T.LongType())]))


def _masks() -> tuple[list[int], list[list[int]]]:
    """The mask of each key, and for each the masks of its chains of 2, 3 and 4 segments."""
    at = np.cumsum((0, *WIDTHS))
    ones = lambda i, j: ((1 << int(j)) - 1) ^ ((1 << int(i)) - 1)
    segment = [ones(at[i], at[i + 1]) for i in range(RING)]
    keys, chains = [], []
    for i in range(RING):
        halves = []
        for s in ((i + 1) % RING, (i + 2) % RING):
            mid = at[s] + WIDTHS[s] // 2
            halves.append((ones(at[s], mid), ones(mid, at[s + 1])))
        (a1, a2), (b1, b2) = halves
        chain = [segment[i]]
        for k in range(1, RING - 1):
            chain.append(chain[-1] | segment[(i + k) % RING])
        for pair in (a1 | a2, a1 | b1, a1 | b2, a2 | b1, a2 | b2):
            keys.append(segment[i] | pair)
            chains.append(chain[1:])
    return keys, chains


KEYS, CHAINS = _masks()
_CHAINS = [np.array(c, np.uint64) for c in CHAINS]


def _linked(x: np.ndarray, chains: np.ndarray) -> np.ndarray:
    """Which of the differences ``x`` keep every chain's budget and then DISTANCE in all."""
    left = np.arange(len(x))
    for l, mask in enumerate(chains, 2):
        left = left[np.bitwise_count(x[left] & mask) <= l * DISTANCE // RING]
        if not len(left):
            return left
    return left[np.bitwise_count(x[left]) <= DISTANCE]


def _link_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (k, *_), (fps,) in groups(batches, 4):
        values = fps.to_numpy(zero_copy_only=False).view(np.uint64)
        found = forest(len(values), lambda i, others: _linked(values[others] ^ values[i], _CHAINS[k]))  # noqa: B023
        if found:
            ends = values.view(np.int64)[np.array(found)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def links(values: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect whatever is connected among the distinct ``fp`` of ``values``."""
    signed = [m - (1 << 64) if m >> 63 else m for m in KEYS]
    keyed = values.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("k", "bits"), "fp")
    return dealt(keyed, ["k", "bits"], "fp", chunk).mapInArrow(_link_units, "a long, b long")


def named_values(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(fp, root, component_id, n) for each distinct ``fp`` of ``rows`` (doc_id, fp), ``n`` of them."""
    values = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-values")
    found = stored(links(values.select("fp"), chunk), "simhash-links")
    roots = components(found)
    grouped = stored(values.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node"), "simhash-roots")
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    return stored(joined(grouped, ids, ["root"], "members").select("fp", "root", "component_id", "n"), "simhash-named")


def near_groups(docs: DataFrame, *, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero, linked like any other. The
    component's id is the smallest doc_id in it (null ids only if there is no
    other). Repeated rows have equal rows; an empty table gives none; other
    columns are ignored.
    """
    rows = stored(fingerprints(docs, shingle), "simhash-fps")
    named = named_values(rows, chunk)
    return joined(rows, named, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id, null ids last, repeated ids by fingerprint.

    Rows and columns, whatever their names, are untouched. Null texts and texts
    without words are one component with fingerprint zero; of rows that agree
    in id and fingerprint one stays, any. Only rows that may have to go are
    moved. An empty table gives no rows.
    """
    rows = numbered(docs, "simhash-rows")
    slim = rows.select("key", field("doc_id").alias("doc_id"), field("text").alias("text"))
    slim = stored(fingerprints(slim, keep=("key", "doc_id")), "simhash-fps")
    named = named_values(slim)
    rooted = stored(joined(slim, named, ["fp"], "n").select("key", "doc_id", "fp", "root"), "simhash-rooted")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "key")).alias("best")
    kept = stored(rooted.groupBy("root").agg(best, F.count("*").alias("n")), "simhash-kept")
    gone = stored(joined(rooted, kept.where("n > 1"), ["root"], "n").where("key <> best.key").select("key"), "simhash-gone")
    maybe, stay = Sieve(gone).split(rows)
    return stay.unionByName(maybe.join(gone, "key", "left_anti")).select("whole.*")
