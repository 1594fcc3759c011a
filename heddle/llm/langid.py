"""Language identification: script ranges, per-word scores, and Viterbi spans.

Each word gets a score for each language: the mean log-probability of its
letter n-grams, hashed into a fixed table. Its script narrows the candidates to
languages that were seen in that script; only those are scored. Viterbi then labels all words of a
text, paying a penalty for each switch of language, so stray look-alikes don't
break a span but a quoted passage in another language is one.

Training counts n-grams of a sample of about ``sample_rows`` labelled rows of
each language (documented bound); rows are drawn by a hash of their id. What
reaches the driver is one row for each (language, table cell), whatever the
input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.errors import DatasetError

#: Labelled rows to learn from, about, of each language: the chance of each row is set so that this many are expected.
SAMPLE_ROWS = 2000
CELLS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Log-units: weight of a word's mean score, price of a switch, and the score of languages that aren't candidates: no path pays that for a word.
WORD_WEIGHT, SWITCH, OUTSIDE = 2.0, 8.0, -1e6
#: Languages whose tables are sent to every task: 256 kB each.
MOST_LANGUAGES = 1024
#: A language is a candidate for a script that has at least this share of its letters.
LEAST_SHARE = 0.01
#: Bounds of a task's memory, not of what is read: words whose scores are kept, words that are labelled together (of both at most
#: HELD, times languages), words times languages that are scored at once, distinct words that are counted together, rows taken from a batch at once.
CACHED, TOGETHER, HELD = 300_000, 1_000_000, 4_000_000
PART, COUNTED, ROWS = 40_000, 50_000, 256

UNDETERMINED = "und"
NAMES = ("lang_pred", "score", "n_spans", "spans")
_WORD = re.compile(r"[^\W\d_]+")
_RUNS, _RUN_SPANS = _WORD.findall, _WORD.finditer


def words_of(text: str) -> list[str]:
    """Runs of letters. Numerals that aren't digits, such as ², ½, ① and 〇, end a word, as digits do."""
    found = _RUNS(text)
    if "".join(found).isalpha():
        return found
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of ``words_of`` stands."""
    out = []
    for m in _RUN_SPANS(text):
        at, run = m.start(), m[0]
        for letters, part in groupby(run, str.isalpha):
            n = len(list(part))
            if letters:
                out.append((at, at + n))
            at += n
    return out


#: First code points of the ranges in which one script is written; between them, "other".
RANGES = (
    (0x41, 0x250, "latin"), (0x250, 0x370, "latin"), (0x370, 0x400, "greek"), (0x400, 0x530, "cyrillic"), (0x530, 0x590, "armenian"),
    (0x590, 0x600, "hebrew"), (0x600, 0x780, "arabic"), (0x900, 0x980, "devanagari"), (0x980, 0xA00, "bengali"), (0xB80, 0xC00, "tamil"),
    (0xE00, 0xE80, "thai"), (0x10A0, 0x1100, "georgian"), (0x1100, 0x1200, "hangul"), (0x1E00, 0x1F00, "latin"), (0x1F00, 0x2000, "greek"),
    (0x3040, 0x3100, "kana"), (0x3400, 0xA000, "han"), (0xAC00, 0xD7B0, "hangul"), (0xF900, 0xFB00, "han"), (0x20000, 0x32000, "han"),
)
SCRIPTS = sorted({r[2] for r in RANGES} | {"other"})


def script_of(letter: str) -> str:
    code = ord(letter)
    for first, end, name in RANGES:
        if first <= code < end:
            return name
    return "other"


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def cells_of(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each word starts among all letters of all words (with a border on either side), and for each n-gram order the table cell at each letter and whether the n-gram lies in one word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    out, rolled = [], np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        rolled[: len(codes) - n + 1] += codes[n - 1 :] * _MIX[n - 1]
        h = rolled ^ (rolled >> np.uint64(31))
        h *= _MIX[1]
        out.append(((h >> np.uint64(40)).astype(np.int64) % CELLS, left >= n))
    return ends - lengths, out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # CELLS x languages: log-probabilities less their mean
    candidates: dict[str, np.ndarray]  # script -> the languages that are written in it, or all if none is known to be

    def words(self, words: list[str]) -> np.ndarray:
        """One row of scores for each word: those of its script's candidates; all others have OUTSIDE."""
        rows = np.full((len(words), len(self.langs)), OUTSIDE, np.float32)
        scripts: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            scripts.setdefault(script_of(w[0]), []).append(i)
        for script, at in scripts.items():
            cols = self.candidates[script]
            rows[np.ix_(at, cols)] = self._scores([words[i] for i in at], cols) if len(cols) > 1 else 0
        return rows

    def _scores(self, words: list[str], cols: np.ndarray) -> np.ndarray:
        starts, orders = cells_of(words)
        table = self.table if len(cols) == len(self.langs) else self.table[:, cols]
        total = np.zeros((int(starts[-1]) + len(words[-1]) + 2, len(cols)), np.float32)
        n = np.zeros(len(total), np.float32)
        for cells, inside in orders:
            total[inside] += table[cells[inside]]
            n += inside
        return np.add.reduceat(total, starts) / np.add.reduceat(n, starts)[:, None] * np.float32(WORD_WEIGHT)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n), in parts to be added up; scripts are counted in letters at cells from -1 downwards."""
    seen: dict[str, Counter] = {}
    for b in batches:
        for part in _slices(b):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text.lower()))
            if sum(map(len, seen.values())) > COUNTED:
                yield from _counted(seen)
                seen = {}
    yield from _counted(seen)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, ROWS) for at in range(0, b.num_rows, ROWS))


def _counted(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, words in seen.items():
        cells, scripts = np.zeros(CELLS), Counter()
        for word, n in words.items():
            scripts[script_of(word[0])] += n * len(word)
        for part in batched(words.items(), COUNTED // 5):
            own, times = zip(*part)
            starts, orders = cells_of(list(own))
            n = np.repeat(np.array(times, np.float64), np.fromiter(map(len, own), np.int64, len(own)) + 2)
            for at, inside in orders:
                cells += np.bincount(at[inside], n[inside], CELLS)
        used = np.flatnonzero(cells)
        names = [-1 - SCRIPTS.index(s) for s in scripts]
        at = np.concatenate([used, np.array(names, np.int64)]).astype(np.int64)
        n = np.concatenate([cells[used], np.array(list(scripts.values()), np.int64)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n)], names=["lang", "cell", "n"])


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from ``doc_id``, ``text`` and ``lang``; rows without a language or text don't count.

    Of each language about ``sample_rows`` rows are drawn by a hash of their id,
    and all where there are no more, so a rare language is learned too.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise DatasetError(f"more than {MOST_LANGUAGES} languages")
    large = [(r["lang"], int(sample_rows / r["count"] * (1 << 30))) for r in sizes if r["count"] > sample_rows]
    if large:
        chances = F.broadcast(labelled.sparkSession.createDataFrame(large, "lang string, chance long"))
        rows = rows.join(chances, "lang", "left").where(F.col("chance").isNull() | (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < F.col("chance")))
    # At most CELLS rows of a language.
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    table = np.zeros((CELLS, len(langs)))
    letters = {s: np.zeros(len(langs)) for s in SCRIPTS}
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        grams = own[own["cell"] >= 0]
        table[grams["cell"].to_numpy(), k] = grams["n"].to_numpy()
        for cell, m in own[own["cell"] < 0][["cell", "n"]].itertuples(index=False):
            letters[SCRIPTS[-1 - cell]][k] = m
    table = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * CELLS))
    if langs:
        table -= table.mean(axis=1, keepdims=True)
    total = sum(letters.values()) if langs else np.zeros(0)
    candidates = {}
    for s, m in letters.items():
        own = np.flatnonzero(m >= LEAST_SHARE * np.maximum(total, 1)) if langs else np.zeros(0, np.int64)
        candidates[s] = own if len(own) else np.arange(len(langs))
    return Model(langs, table.astype(np.float32), candidates)


class Labeller:
    """Labels the words of texts; keeps the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.fresh: list[str] = []
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _learn(self, word: str) -> int:
        self.fresh.append(word)
        self.known[word] = at = len(self.known)
        return at

    def score_fresh(self) -> None:
        """Scores the words met since the last call, all at once."""
        n = max(1, PART // max(1, len(self.model.langs)))
        parts = [self.model.words(self.fresh[at : at + n]) for at in range(0, len(self.fresh), n)]
        self.scores = np.concatenate([self.scores, *parts])
        self.letters = np.concatenate([self.letters, np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))])
        self.fresh = []

    def ids(self, words: list[str]) -> np.ndarray:
        known, learn = self.known, self._learn
        return np.fromiter((known[w] if w in known else learn(w) for w in words), np.int32, len(words))

    def paths(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The most likely language of each word of each document, all documents step by step together."""
        if not self.model.langs:
            return [np.zeros(0, np.int8)] * len(docs)
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lengths = np.array([len(docs[i]) for i in order], np.int64)
        flat = np.concatenate([docs[i] for i in order]) if docs else np.zeros(0, np.int32)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        steps, n_langs = int(lengths[0]) if len(lengths) else 0, len(self.model.langs)
        active = np.searchsorted(-lengths, -np.arange(steps), "left")  # documents longer than t
        switched = np.zeros((len(flat), n_langs), bool)
        source = np.zeros(len(flat), np.int8 if n_langs < 128 else np.int16)
        value = np.zeros((len(docs), n_langs), np.float32)
        scores = self.scores
        for t in range(steps):
            n = active[t]
            at = starts[:n] + t
            v = value[:n]
            if t:
                top = v.argmax(axis=1)
                best = v[np.arange(n), top] - SWITCH
                source[at] = top
                moved = v < best[:, None]
                switched[at] = moved
                np.maximum(v, best[:, None], out=v)
            v += scores[flat[at]]
        labels = np.zeros(len(flat), source.dtype)
        now = value.argmax(axis=1).astype(source.dtype)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = starts[:n] + t
            own = now[:n]
            labels[at] = own
            if t:
                now[:n] = np.where(switched[at, own], source[at], own)
        out: list[np.ndarray] = [labels] * len(docs)
        for k, i in enumerate(order):
            out[i] = labels[starts[k] : starts[k] + lengths[k]]
        return out

    def verdict(self, ids: np.ndarray, path: np.ndarray) -> tuple[str, float]:
        """The language with most letters, and its share of them times how sure its own words are of it."""
        letters = self.letters[ids]
        total = int(letters.sum())
        if not total or not self.model.langs:
            return UNDETERMINED, 0.0
        per = np.bincount(path, letters, len(self.model.langs))
        win = int(per.argmax())
        rest = self.scores[ids[path == win]].sum(axis=0, dtype=np.float64)
        odds = np.exp(np.clip(rest - rest[win], -60, 60)).sum()
        return self.model.langs[win], float(per[win] / total / odds) if odds >= 1 else float(per[win] / total)


def identify(docs: DataFrame, model: Model, *, spans: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``keep``, then lang_pred, score, n_spans (and ``spans``).

    ``und`` with score 0 where the text is null or has no letter, and for every
    text if nothing was learned. Whole texts are labelled, however long. Ties
    go to the language that comes first in the alphabet. ``spans`` lists
    (start, end, lang) in code points of the lower-cased text's words. Repeated
    rows give equal rows; an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in keep if c not in ("doc_id", "text")]
    out = ["doc_id", *(["text"] if "text" in keep else []), *carried]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)

        def told(texts: list[str], ids: list[np.ndarray]) -> tuple[list, ...]:
            labeller.score_fresh()
            paths = labeller.paths(ids)
            found = [labeller.verdict(i, p) for i, p in zip(ids, paths)]
            cuts = [np.flatnonzero(p[1:] != p[:-1]) + 1 for p in paths]
            cols = [x[0] for x in found], [x[1] for x in found], [len(c) + bool(len(p)) for c, p in zip(cuts, paths)]
            return (*cols, [_spans(t, p, c, shared.value.langs) for t, p, c in zip(texts, paths, cuts)]) if spans else cols

        room = HELD // max(1, len(shared.value.langs))
        for b in batches:
            texts, ids, held, first = [], [], 0, 0
            for part in _slices(b):
                for text in part.column(1).to_pylist():
                    lower = (text or "").lower()
                    ids.append(labeller.ids(words_of(lower)))
                    texts.append(lower if spans else "")
                    held += len(ids[-1])
                    if held >= min(TOGETHER, room) or first + len(ids) == b.num_rows:
                        cols = told(texts, ids)
                        own = b.slice(first, len(ids))
                        first += len(ids)
                        texts, ids, held = [], [], 0
                        if len(labeller.known) > min(CACHED, room):
                            labeller.clear()
                        arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int32())]
                        if spans:
                            arrays.append(pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                        passed = [own.column(0), *([own.column(1)] if "text" in keep else []), *own.columns[2:]]
                        yield pa.RecordBatch.from_arrays([*passed, *arrays], names=[*out, *NAMES[: len(arrays)]])

    rows = docs.select("doc_id", "text", *carried)
    types = [T.StringType(), T.DoubleType(), T.IntegerType(), T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("lang", T.StringType()))]
    told = zip(NAMES[: 4 if spans else 3], types)
    return rows.mapInArrow(label, T.StructType([*[rows.schema[c] for c in out], *[T.StructField(n, t) for n, t in told]]))


def keep_identified(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """``docs`` without texts that have no letter or whose score, the leading language's share of the letters times its certainty, is under ``least``.

    A short text that several languages may have written is kept: of four alike each has a score of 0.25.

    The model is learned from the table's own ``lang``. Rows and columns are
    otherwise untouched; with no labelled row nothing is known and nothing kept
    but what has letters.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Other columns pass in a struct, so that none can clash with the verdict's.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*[docs[f"`{c}`"] for c in others]).alias("rest")] if others else []
    found = identify(docs.select("doc_id", "text", *rest), model, keep=("text", *(["rest"] if others else [])))
    found = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


def _spans(text: str, path: np.ndarray, cuts: np.ndarray, langs: list[str]) -> list[dict]:
    at = word_spans(text)
    edges = [0, *cuts.tolist(), len(path)]
    return [{"start": at[i][0], "end": at[j - 1][1], "lang": langs[path[i]]} for i, j in zip(edges, edges[1:]) if j > i]
