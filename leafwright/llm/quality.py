"""Ordinal quality classifier: a cumulative-link model on hashed text features (operator 1).

Ratings are grades 0 < 1 < ... < K-1. All grades share one weight vector over hashed text; ordered thresholds t_1 < ... cut its
latent score z: P(grade >= k) = sigmoid(z - t_k). The expected grade is the sum of these tail probabilities, and one of them
decides selection.

Features of a whole text: relative frequencies of byte 3-grams hashed into BUCKETS (square roots, unit length) and a few
shares (distinct words, upper case, digits, marks, blanks, most frequent word, length). Training reads at most SAMPLE rated
rows outside the held-out fold (a hash of the id picks them), in one task: the driver gets the model only. Null and empty texts have zero features. With one grade or no
rating at all every document has that grade (or grade 0) with probability 1 and is selected. Repeated rows and null ids keep
their rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

BUCKETS = 4096
SAMPLE = 4000
SHARES = 8


def features(texts: pa.Array) -> np.ndarray:
    """A row of BUCKETS + SHARES features for each text."""
    raw, bounds = textvec.flat(texts)
    starts, ends, first = textvec.spans(raw, bounds)
    words = textvec.word_hashes(raw, starts, ends, lower=False)
    out = np.zeros((len(bounds) - 1, BUCKETS + SHARES), np.float32)
    x = raw.astype(np.uint32)
    codes = (((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)) >> np.uint32(20) if len(x) > 2 else np.zeros(0, np.uint32)
    kinds = np.zeros(256, np.int64)
    kinds[65:91], kinds[48:58], kinds[textvec.BLANK] = 1, 2, 3
    kinds[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
    kinds[0:9], kinds[14:32], kinds[127] = 5, 5, 5
    for d in range(len(bounds) - 1):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            continue
        n = np.bincount(codes[a : max(a, b - 2)], minlength=BUCKETS)[:BUCKETS]
        out[d, :BUCKETS] = np.sqrt(n / max(1, n.sum()))
        of = np.bincount(kinds[raw[a:b]], minlength=6) / (b - a)
        w = words[first[d] : first[d + 1]]
        _, times = np.unique(w, return_counts=True)
        lines = np.count_nonzero(raw[a:b] == 10)
        out[d, BUCKETS:] = [of[1], of[2], of[4] * 4, of[5], (len(times) / len(w) if len(w) else 0), (times.max() / len(w) if len(w) else 0) * 4, np.log1p(len(w)) / 8, np.log1p(lines) / 4]
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: int

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1."""
        z = x @ self.weights
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -50, 50)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 2e-4) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows; gaps between thresholds are exponentials, so they stay ordered."""
    k = int(y.max()) + 1 if len(y) else 1
    if k < 2 or len(np.unique(y)) < 2:
        return Model(np.zeros(x.shape[1], np.float32), np.zeros(0), 1)
    at_least = np.asarray([(y >= j).mean() for j in range(1, k)]).clip(1e-3, 1 - 1e-3)
    cuts = -np.log(at_least / (1 - at_least))
    cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(k - 1))
    p = np.concatenate([np.zeros(x.shape[1]), cuts[:1], np.log(np.diff(cuts).clip(1e-3))]).astype(np.float64)
    dim, m, v = x.shape[1], np.zeros(len(cuts) + x.shape[1]), np.zeros(len(cuts) + x.shape[1])
    rows = np.arange(len(y))
    for step in range(1, rounds + 1):
        gaps = np.exp(p[dim + 1 :])
        t = p[dim] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = x @ p[:dim].astype(np.float32)
        up = np.c_[np.ones(len(y)), 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -50, 50))), np.zeros(len(y))]
        here, above = up[rows, y], up[rows, y + 1]
        prob = np.maximum(here - above, 1e-9)
        slope = up * (1 - up)
        gz = (slope[rows, y] - slope[rows, y + 1]) / prob  # d log-likelihood / dz
        gt = np.zeros(k - 1)
        for j in range(1, k):
            gt[j - 1] = np.sum(((y + 1 == j) * slope[:, j] - (y == j) * slope[:, j]) / prob)
        grad = np.concatenate([-(x.T @ gz.astype(np.float32)) / len(y) + ridge * p[:dim], [-gt.sum() / len(y)], -np.asarray([gt[j:].sum() for j in range(1, k - 1)]) * gaps / len(y)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = p[dim] + np.concatenate([[0.0], np.cumsum(np.exp(p[dim + 1 :]))])
    return Model(p[:dim].astype(np.float32), t, k)


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample rows of ratings (doc_id, grade int); null grades are left out."""
    common.ready(docs.sparkSession)

    def run(batches):
        common.hold()
        x, y = np.empty((sample, BUCKETS + SHARES), np.float32), np.zeros(sample, np.int64)
        n = 0
        for batch in batches:
            for part in common.pieces(batch):
                x[n : n + len(part)], y[n : n + len(part)] = features(part.column(1)), np.asarray(part.column(0))
                n += len(part)
        model = train(x[:n], y[:n])
        del x, y
        common.trim()
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.thresholds.tobytes()]), pa.array([model.grades], pa.int64())], names=["weights", "thresholds", "grades"])

    rated = common.labelled_sample(docs, ratings.where("grade is not null"), ["grade"], sample).select("doc_id", F.col("grade").cast("long").alias("grade"), "text")
    got = common.in_one_task(rated, "doc_id").select("grade", "text").mapInArrow(run, "weights binary, thresholds binary, grades long").collect()
    if not got:  # Spark may leave out a task that has no rows
        return train(np.zeros((0, BUCKETS + SHARES), np.float32), np.zeros(0, np.int64))
    return Model(np.frombuffer(got[0].weights, np.float32), np.frombuffer(got[0].thresholds, np.float64), got[0].grades)


def score(docs: DataFrame, model: Model, cut: int = 1, at: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, p_at_least (tail probability of grade cut), selected for each row of docs (doc_id, text)."""
    common.ready(docs.sparkSession)

    def run(batches):
        common.hold()
        for batch in batches:
            for part in common.pieces(batch, most=1 << 20):
                tails = model.tails(features(part.column(1))) if model.grades > 1 else np.zeros((len(part), 0))
                p = tails[:, cut - 1] if cut - 1 < tails.shape[1] else np.ones(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(1).astype(np.float64)), pa.array(p.astype(np.float64))], names=["doc_id", "expected_grade", "p_at_least"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, p_at_least double")
    return scored.select("doc_id", F.coalesce(common.held_out(), F.lit(False)).alias("held_out"), "expected_grade", "p_at_least", (F.col("p_at_least") >= at).alias("selected"))


def select(docs: DataFrame, model: Model, cut: int = 1, at: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose tail probability of grade cut is at or more."""
    common.ready(docs.sparkSession)

    def run(batches):
        common.hold()
        for batch in batches:
            for part in common.pieces(batch, most=1 << 20):
                if cut - 1 < len(model.thresholds):
                    p = model.tails(features(part.column(part.schema.get_field_index("text"))))[:, cut - 1]
                    part = part.filter(pa.array(p >= at))
                yield part

    return docs.mapInArrow(run, docs.schema)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from labels: 0 for poor quality, 1 for good but toxic text, 2 for good text; null quality has no rating."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull(), F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2)).alias("grade"))
