"""A quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a short vector of statistics, each bounded or on a log
scale. The two classes are Gaussians whose covariances are shrunk towards the
pooled one and a multiple of the identity. A score is the logistic function of
the difference of their log-densities, from Mahalanobis distances by Cholesky
factors that are computed once and kept with the model.

Fitting needs only each class's count, sums and products of statistics: these
are summed over all labelled rows, not a sample, and one small row reaches the
driver from each task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import stored, text_of

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "letters", "capitals", "digits", "symbols", "bars", "shouts", "stops", "commas",
    "high", "distinct", "short", "entropy", "log_line", "line_copies", "squeezed", "top_word",
)
#: Shares of the pooled covariance and of the identity in each class's covariance.
POOLED, RIDGE = 0.5, 0.05

_UPPER, _LOWER, _DIGIT = (np.frombuffer(s, np.uint8) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
_SYMBOL = np.frombuffer(b"#$%&*<>@^~=+_\\/{}[]", np.uint8)


def statistics(text: str) -> np.ndarray:
    """The vector of a whole text; an empty one has the statistics of nothing."""
    raw = text.encode()
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = seen[_UPPER].sum(), seen[_LOWER].sum()
    high = seen[128:].sum()
    share = seen[seen > 0] / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    root = np.sqrt
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p((n - seen[32] - seen[10]) / m), (upper + lower + high) / n,
        root(upper / max(1, upper + lower)), root(seen[_DIGIT].sum() / n), root(seen[_SYMBOL].sum() / m), root(seen[124] / m), root(seen[33] / m),
        root((seen[46] + seen[63]) / m), root(seen[44] / m), root(high / n), np.log(max(1, len(tally)) / m), sum(v for k, v in tally.items() if len(k) <= 3) / m,
        -(share * np.log(share)).sum() if len(raw) else 0.0, np.log1p(n / max(1, len(lines))), root(1 - len(set(lines)) / max(1, len(lines))) if lines else 0.0,
        np.log(len(zlib.compress(raw, 1)) / (n + 20)), root(max(tally.values(), default=0) / m),
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with x the statistics of the whole text; null texts are empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.concatenate([statistics(t) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros(0)
            ends = pa.array(np.arange(0, len(found) + 1, len(STATISTICS), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(found))], names=["doc_id", "x"])

    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    centre: np.ndarray  # of the standardisation
    scale: np.ndarray
    means: np.ndarray  # 2 x d
    factors: np.ndarray  # 2 x d x d: inverse Cholesky factors
    offsets: np.ndarray  # 2: log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [self.offsets[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """From rows of (x, label): label 0 or 1, other labels and nulls don't count. A class without rows gets the other's shape."""
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            y = b.column(1).to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(total.tolist(), pa.list_(pa.float64())), pa.array([0, 1], pa.int32())], names=["sums", "label"])

    rows = labelled.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    parts = rows.mapInArrow(sums, "sums array<double>, label int")
    # Summed before it moves: a row for each class and element.
    parts = parts.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for label, at, v in parts:  # 2 x (1 + d + d * d) rows
        total[label, at] = v
    n = total[:, 0]
    everything = total.sum(axis=0)
    centre = everything[1 : 1 + d] / max(1, n.sum())
    spread = everything[1 + d :].reshape(d, d).diagonal() / max(1, n.sum()) - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-8))
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        if n[k]:
            mean = total[k, 1 : 1 + d] / n[k]
            covs[k] = (total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
            means[k] = (mean - centre) / scale
    within = (covs * n[:, None, None]).sum(axis=0) / max(1, n.sum())
    factors, offsets = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        share = pooled if n[k] > d else 1.0
        cov = (1 - share - ridge) * covs[k] + share * within + ridge * np.eye(d) if share < 1 else (1 - ridge) * within + ridge * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors[k] = np.linalg.inv(lower)
        offsets[k] = np.log((n[k] + 1) / (n.sum() + 2)) - np.log(lower.diagonal()).sum()
    return Discriminant(centre, scale, means, factors, offsets)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score): the chance of label 1."""
    d = len(STATISTICS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(of, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, learn_from) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted.

    ``labels`` has doc_id and label; ``learn_from`` is a condition on doc_id.
    A document with several labels counts once for each. Empty and null texts
    are scored like any other; without labels every score is that of equal
    classes. Repeated rows give equal rows; an empty table none; other columns
    of either table are ignored.
    """
    stats = stored(with_statistics(docs), "quality-statistics")
    known = labels.where("label is not null").where(learn_from).select(F.col("doc_id").alias("l_id"), "label")
    model = fit(stats.join(known, F.col("doc_id") == F.col("l_id")).select("x", "label"))
    return scored(stats, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
