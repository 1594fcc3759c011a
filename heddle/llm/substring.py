"""Substring de-duplication: passages that repeat across documents, by MinHash bands of paragraphs and verified alignments.

A repeated passage needn't begin or end at a line, so every PARAGRAPH
consecutive words of a text are a paragraph, a set of five-word shingles. ROWS
MinHashes of a paragraph make a *band*; paragraphs that agree in a band collide.
Paragraphs that follow each other mostly have the same MinHashes, so a text has
few bands of its own: about 0.18 a word for two rows. ``bands`` tunes how many
are needed: a passage of 50 words or more whose copy has a Jaccard similarity of
SIMILARITY keeps PARAGRAPH words in a row unchanged, those collide for certain,
and so one band is enough.

Bands that occur in one document only are dropped. The others are aligned with
the first document that holds them, at the shingle that is the band's first
MinHash: bands that stand at one distance with equal words between them are a
run (a running checksum of the shingles tells), runs are extended word by word
over the text around them, through edits as long as the Jaccard similarity of
the whole is SIMILARITY or more, and what has LEAST words then is a passage.

Scale: a bitmap of the bands that are shared, 16 MB at most, is sent to all
tasks, so bands of one document aren't moved to find their partners; bands that
very many documents share are joined where they are (``common.joined``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import Sieve, joined, stored, text_of
from heddle.llm.components import components
from heddle.llm.units import CHUNK

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a paragraph, MinHashes of a band, the share of similar passages to find, and the fewest words of a passage.
PARAGRAPH, ROWS, RECALL, LEAST = 24, 2, 0.99, 20
SHINGLES = PARAGRAPH - SHINGLE + 1
#: Words on each side of a run that it may extend over: 50 more without a band are under SIMILARITY by themselves.
CONTEXT = 50
CACHED = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def bands(words: int, paragraph: int = PARAGRAPH, rows: int = ROWS, recall: float = RECALL) -> int:
    """How many bands find a passage of ``words`` words with as many changed words, evenly spread, as SIMILARITY allows.

    Counts the paragraph with the fewest changes alone: one of similarity s
    collides in a band with the chance s ** rows.
    """
    whole, set_ = words - SHINGLE + 1, paragraph - SHINGLE + 1
    most = int(whole * (1 - SIMILARITY) / (SHINGLE * (1 + SIMILARITY)))
    changed = np.zeros(words, bool)
    changed[[words * (k + 1) // (most + 1) for k in range(most)]] = True
    lost = np.convolve(changed, np.ones(SHINGLE), "valid") > 0
    same = set_ - int(min(np.convolve(lost, np.ones(set_), "valid")))
    chance = (same / (2 * set_ - same)) ** rows
    return 1 if chance >= recall else int(np.ceil(np.log(1 - recall) / np.log1p(-chance)))


BANDS = max(map(bands, range(50, 500)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[5]
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _extreme(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` consecutive values."""
    have, done = x, 1
    while 2 * done <= width:
        have, done = op(have[: len(have) - done], have[done:]), 2 * done
    rest = width - done
    return op(have[: len(have) - rest], have[rest:]) if rest else have


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """A hash of each five consecutive word hashes."""
    m = len(hashes) - SHINGLE + 1
    total = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        total += hashes[k : k + m] * _ODD[k]
    return _mix(total)


def bands_of(text: bytes, words: dict, n_bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(place, key, checksum) of a text's bands; None if it has no paragraph.

    The place is that of the first shingle with the band's first MinHash, the
    checksum that of all shingles before it. A band that paragraphs in a row
    share is there once.
    """
    cut = text.lower().split()
    if len(cut) < PARAGRAPH:
        return None
    shingles = shingles_of(np.fromiter(map(words.__getitem__, cut), np.uint64, len(cut)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_mix(shingles * _ODD[7]))])
    found = []
    for band in range(n_bands):
        key = np.full(len(shingles) - SHINGLES + 1, band, np.uint64)
        for row in range(rows):
            k = band * rows + row
            order = _mix(shingles ^ (_ODD[[k % 8]] * np.uint64(2 * k + 1)))
            first = order if row == 0 else first
            key = _mix(key * _ODD[6] + _extreme(order, SHINGLES, np.minimum))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at = new + first[new[:, None] + np.arange(SHINGLES)].argmin(axis=1)
        found.append((at, key[new], sums[at]))
    return tuple(np.concatenate(c) for c in zip(*found))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, at, key, sum, first): the bands of whole texts, and whether the text has the band there first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            which, cols = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = bands_of(text.encode(), words)
                if found is not None:
                    at, key, total = found
                    first = np.zeros(len(key), bool)
                    first[np.unique(key, return_index=True)[1]] = True
                    which.append(np.full(len(at), i))
                    cols.append((at, key, total, first))
            if not cols:
                continue
            at, key, total, first = (np.concatenate(c) for c in zip(*cols))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.concatenate(which))), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(total.view(np.int64)), pa.array(first)],
                names=["doc_id", "at", "key", "sum", "first"])

    rows = docs.where("doc_id is not null").select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, at int, key long, sum long, first boolean")


def _contexts(docs: DataFrame, wanted: DataFrame, chunk: int) -> DataFrame:
    """(id, lo, hi, left, right) for ``wanted`` (id, lo, hi): the CONTEXT words before and after, one blank between words."""
    places = wanted.distinct().groupBy(F.col("id").alias("w_id"), F.floor(F.col("lo") / chunk)).agg(F.collect_list(F.struct("lo", "hi")).alias("places"))  # of ``chunk`` words of one text

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, los, his, lefts, rights = [], [], [], [], []
            for i, (text, places) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                cut = text.encode().lower().split()
                for p in places:
                    lo, hi = p["lo"], p["hi"]
                    if hi <= len(cut):
                        which.append(i)
                        los.append(lo)
                        his.append(hi)
                        lefts.append(b" ".join(cut[max(0, lo - CONTEXT) : lo]))
                        rights.append(b" ".join(cut[hi : hi + CONTEXT]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which, pa.int64())), pa.array(los, pa.int32()), pa.array(his, pa.int32()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], names=["id", "lo", "hi", "left", "right"])

    rows = docs.join(places, F.col("doc_id") == F.col("w_id")).select("doc_id", text_of().alias("text"), "places")
    found = rows.mapInArrow(of, f"id {rows.schema['doc_id'].dataType.simpleString()}, lo int, hi int, left binary, right binary")
    return found.dropDuplicates(["id", "lo", "hi"])


def steps(a: list[bytes], b: list[bytes]) -> list[tuple[int, int, int, int]]:
    """How far two texts agree: (words of a, words of b, shingles shared, shingles lost) up to each edit.

    Both go on from words they share, so each equal word is one more shared
    shingle. Behind an edit the texts meet again where five words are equal.
    """
    x, most = 0, min(len(a), len(b))
    while x < most and a[x] == b[x]:
        x += 1
    y = shared = x
    lost = 0
    found = [(x, y, shared, lost)]
    if x == most:
        return found
    places: dict[tuple, list[int]] = {}
    for j in range(y, len(b) - SHINGLE + 1):
        places.setdefault(tuple(b[j : j + SHINGLE]), []).append(j)
    while True:
        best = None
        for i in range(x, len(a) - SHINGLE + 1):
            if best and i - x >= best[0]:
                break
            j = next((j for j in places.get(tuple(a[i : i + SHINGLE]), ()) if j >= y), None)
            if j is not None and (best is None or i - x + j - y < best[0]):
                best = i - x + j - y, i, j
        if best is None:
            return found
        lost += best[0] + 2 * (SHINGLE - 1)
        x, y = best[1:]
        run = 0
        while x < len(a) and y < len(b) and a[x] == b[y]:
            x, y, run = x + 1, y + 1, run + 1
        shared += run - SHINGLE + 1
        found.append((x, y, shared, lost))


def extended(words: int, left: list[tuple], right: list[tuple]) -> tuple[tuple, tuple]:
    """The steps to the left and right that add most to a run of ``words`` equal words at SIMILARITY or more."""
    core = words - SHINGLE + 1
    return max(
        ((p, q) for p in left for q in right if core + p[2] + q[2] >= SIMILARITY * (core + p[2] + q[2] + p[3] + q[3]) - 1e-9),
        key=lambda pq: (pq[0][2] + pq[1][2], -pq[0][3] - pq[1][3]),
    )


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (doc_id, first_id, lo, hi, shift) with both contexts, extended: (doc_id, first_id, lo, hi, f_lo, f_hi)."""
    for b in batches:
        keep, cols = [], []
        for i, (lo, hi, shift, *around) in enumerate(zip(*[b.column(c).to_pylist() for c in range(2, 9)])):
            left, right, f_left, f_right = (x.split() for x in around)
            p, q = extended(hi - lo, steps(left[::-1], f_left[::-1]), steps(right, f_right))
            own = lo - p[0], hi + q[0], lo - shift - p[1], hi - shift + q[1]
            if min(own[1] - own[0], own[3] - own[2]) >= LEAST:
                keep.append(i)
                cols.append(own)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), *[pa.array([c[k] for c in cols], pa.int32()) for k in range(4)]], names=["doc_id", "first_id", "lo", "hi", "f_lo", "f_hi"])


def merged(spans: list[tuple]) -> list[list]:
    """Spans that overlap as one, with the least of what follows (start, end)."""
    found: list[list] = []
    for lo, hi, *rest in sorted(spans):
        if found and lo < found[-1][1]:
            found[-1][1] = max(found[-1][1], hi)
            found[-1][2:] = min(found[-1][2:], rest)
        else:
            found.append([lo, hi, *rest])
    return found


def without(spans: list[list], gone: list[list]) -> list[tuple[int, int]]:
    """The parts of ``spans`` that lie between the spans of ``gone``, if of LEAST words or more."""
    found, g = [], 0
    for lo, hi in spans:
        while g < len(gone) and gone[g][1] <= lo:
            g += 1
        k = g
        while k < len(gone) and gone[k][0] < hi:
            found.append((lo, gone[k][0]))
            lo = max(lo, gone[k][1])
            k += 1
        found.append((lo, hi))
    return [(lo, hi) for lo, hi in found if hi - lo >= LEAST]


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages (start, end, kept, first_id, f_lo, f_hi) of each document, and ``start`` of the passage of each span (f_lo, f_hi) that others are aligned with (kept null)."""
    for b in batches:
        which, cols = [], []
        for i, spans in enumerate(b.column(1).to_pylist()):
            gone = merged([(s["lo"], s["hi"], s["first_id"], s["f_lo"], s["f_hi"]) for s in spans if s["first_id"] is not None])
            first = sorted({(s["lo"], s["hi"]) for s in spans if s["first_id"] is None})
            rows = sorted([(lo, hi, False, *rest) for lo, hi, *rest in gone] + [(lo, hi, True, None, None, None) for lo, hi in without(merged(first), gone)], key=lambda r: r[0])
            starts = [r[0] for r in rows]
            told = []
            for lo, hi in first:
                near = rows[max(0, bisect_right(starts, lo) - 1) : bisect_left(starts, hi)]
                start, end = max(near, key=lambda r: min(hi, r[1]) - max(lo, r[0]))[:2]
                told.append((start, end, None, None, lo, hi))
            which += [i] * (len(rows) + len(told))
            cols += rows + told
        types = pa.int32(), pa.int32(), pa.bool_(), b.column(0).type, pa.int32(), pa.int32()
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(which, pa.int64())), *[pa.array([c[k] for c in cols], t) for k, t in enumerate(types)]], names=["doc_id", "start", "end", "kept", "first_id", "f_lo", "f_hi"])


def repeats(docs: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start, end, cluster_id, first_doc_id, kept.

    ``start`` and ``end`` are word numbers (ASCII white space separates words),
    end exclusive. A passage not ``kept`` is one that an earlier document
    (smaller id) has, word by word or at a similarity of SIMILARITY or more; a
    ``kept`` one has no earlier occurrence, and a document's passages don't
    overlap, so each removed word (or edit inside a similar passage) has its
    counterpart in an earlier document and one copy of everything stays. Alignments that overlap make one passage.
    Passages that were aligned are a cluster, ``cluster_id``, whose smallest id
    is ``first_doc_id``. Passages have LEAST words or more and end where
    words differ, or up to four words before the edge behind a last edit. Only
    passages that occur in two documents are listed; others, null and short
    texts and rows without an id give no row. Rows that repeat an id and a text
    are one document; rows that repeat an id with different texts are documents
    of their own, in the order of their texts' hashes. An empty table gives no
    rows; other columns are ignored. ``chunk`` bounds the words whose contexts
    are fetched at once.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _repeats(rows, chunk)
    # Where ids repeat, a document is known by its id and its text's hash.
    rows = rows.where("doc_id is not null").select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text").dropDuplicates(["doc_id"])
    found = _repeats(stored(rows, "paragraph-texts"), chunk)
    return found.withColumns({"doc_id": F.col("doc_id.doc_id"), "first_doc_id": F.col("first_doc_id.doc_id")})


def _repeats(docs: DataFrame, chunk: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    all_ = stored(paragraphs(docs), "paragraphs")
    shared = all_.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).where("first_id <> last_id")
    shared = stored(shared.select("key", "first_id", "n"), "paragraph-bands")
    near = stored(Sieve(shared).split(all_)[0], "paragraph-collisions")
    met = stored(joined(near, shared, ["key"], "n").select("key", "doc_id", "at", "sum", "first", "first_id", "n"), "paragraph-met")
    firsts = met.where("first and doc_id = first_id").groupBy("key").agg(F.min(F.struct("at", "sum")).alias("f"), F.max("n").alias("n"))
    met = joined(met.drop("n"), stored(firsts, "paragraph-firsts"), ["key"], "n")
    met = met.select("doc_id", "at", "first_id", (F.col("at") - F.col("f.at")).alias("shift"), F.col("sum").bitwiseXOR(F.col("f.sum")).alias("apart"))

    # One run for bands of a document that stand at one distance from those of the first document, with equal shingles between them.
    by_place = Window.partitionBy("doc_id", "first_id", "shift").orderBy("at")
    runs = met.where("doc_id <> first_id or shift <> 0").withColumn("new", F.when(F.lag("apart").over(by_place) == F.col("apart"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    runs = stored(runs.groupBy("doc_id", "first_id", "shift", "run").agg(F.min("at").alias("lo"), (F.max("at") + SHINGLE).alias("hi")).drop("run"), "paragraph-runs")

    wanted = runs.select(F.col("doc_id").alias("id"), "lo", "hi").union(runs.select("first_id", F.col("lo") - F.col("shift"), F.col("hi") - F.col("shift")))
    around = stored(_contexts(docs, wanted, chunk), "paragraph-contexts")
    own = around.select(F.col("id").alias("doc_id"), "lo", "hi", "left", "right")
    first = around.select(F.col("id").alias("first_id"), F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"), F.col("left").alias("f_left"), F.col("right").alias("f_right"))
    place = ["first_id", "f_lo", "f_hi"]
    met = runs.withColumns({"f_lo": F.col("lo") - F.col("shift"), "f_hi": F.col("hi") - F.col("shift")})
    first = stored(first.join(met.groupBy(*place).agg(F.count("*").alias("n")), place), "paragraph-first-contexts")
    both = joined(met, first, place, "n").join(own, ["doc_id", "lo", "hi"])
    both = both.select("doc_id", "first_id", "lo", "hi", "shift", "left", "right", "f_left", "f_right")
    aligned = stored(both.mapInArrow(_aligned, f"doc_id {kind}, first_id {kind}, lo int, hi int, f_lo int, f_hi int"), "paragraph-alignments")

    # What has no first_id is kept: it is, or stands in, the first document.
    none, away = F.lit(None), F.col("doc_id") != F.col("first_id")
    spans = aligned.select("doc_id", "lo", "hi", *[F.when(away, F.col(c)).alias(c) for c in ("first_id", "f_lo", "f_hi")])
    spans = spans.union(aligned.where(away).select("first_id", "f_lo", "f_hi").distinct().select("*", none.cast(kind), none.cast("int"), none.cast("int")))
    per = spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "first_id", "f_lo", "f_hi")).alias("spans"))  # at most the runs of one text
    found = stored(per.mapInArrow(_passages, f"doc_id {kind}, start int, end int, kept boolean, first_id {kind}, f_lo int, f_hi int"), "passages")

    # Each passage that isn't kept points to one of an earlier document.
    named = found.withColumn("node", F.xxhash64("doc_id", "start"))
    passages = named.where("kept is not null")
    told = named.where("kept is null").select(F.col("doc_id").alias("first_id"), "f_lo", "f_hi", F.col("node").alias("b"))
    gone = passages.where("not kept")
    told = stored(told.join(gone.groupBy(*place).agg(F.count("*").alias("n")), place), "passages-told")
    roots = components(joined(gone, told, place, "n").select(F.col("node").alias("a"), "b"))
    rooted = passages.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").withColumn("cluster_id", F.coalesce("root", "node"))
    rooted = rooted.select("doc_id", "start", "end", "cluster_id", "kept")
    rooted = stored(rooted, "passages-rooted")
    firsts = stored(rooted.groupBy("cluster_id").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")), "passages-firsts")
    return joined(rooted, firsts, ["cluster_id"], "n").select("doc_id", "start", "end", "cluster_id", "first_doc_id", "kept")
