"""Toxicity by compression distance with zstandard dictionaries (operator 5).

Two dictionaries are trained with zstandard's own trainer: one on windows of ordinary texts, one on the segments of toxic
texts that ordinary texts lack. Every window of a text (WINDOW bytes, STEP apart, the whole text) is compressed once with the
ordinary dictionary and once with the toxic one, which holds the toxic segments before the ordinary content, so that the two
lengths differ only by what toxic text explains. The counts of a text's windows above each saved-bytes threshold are its
distances; a logistic fit on labelled texts calibrates them to a score between 0 and 1.

Labels are read only of ids with crc32(id) mod 5 <> 0, at most SAMPLE of them (a hash of the id picks); one task learns from them and the
driver gets the model only. All of these, with their
whole texts, train the ordinary dictionary and the calibration, so that scores keep the labels' share of toxic texts; language, source, id
and label are never inputs of a score. Null and empty texts are one empty window and get the score of a text with no toxic
window. Without labels of both kinds the score is the share of toxic ones (0 without any). Repeated rows and null ids keep
their rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, STEP = 96, 80
SAMPLE = 6000
GRAM, LEAST, LIFT, SURE, REPEATS = 6, 3, 4, 6, 6
ORDINARY_BYTES, TOXIC_BYTES = 100_000, 8192
_LOW, _HIGH = -4, 10
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Model:
    """Raw dictionary contents and the calibration; toxic is None if there is no toxic text to learn from."""

    ordinary: bytes
    toxic: bytes | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def compressors(self):
        import zstandard as z

        params = z.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, strategy=z.STRATEGY_LAZY2, write_content_size=0, write_dict_id=0, write_checksum=0, format=z.FORMAT_ZSTD1_MAGICLESS
        )
        return [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params) for d in (self.ordinary, self.toxic + self.ordinary)]

    def distances(self, texts: list[bytes]) -> np.ndarray:
        """A row of window counts by saved bytes, and their totals above two thresholds, for each text."""
        plain, toxic = (c.compress for c in self.compressors())
        out = np.zeros((len(texts), _HIGH - _LOW + 3))
        for k, t in enumerate(texts):
            t = t.translate(_LOWER)
            windows = [t[i : i + WINDOW] for i in range(0, max(1, len(t) - (WINDOW - STEP)), STEP)]
            saved = np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows), np.int64, len(windows))
            n = np.bincount(np.clip(saved, _LOW, _HIGH) - _LOW, minlength=_HIGH - _LOW + 1)
            out[k, :-2] = np.sqrt(n / len(windows))
            out[k, -2:] = np.log1p(n[3 - _LOW :].sum()), np.log1p(n[5 - _LOW :].sum())
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.toxic is None:
            return np.full(len(texts), float(self.weights[-1]))
        x = (self.distances(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def _segments(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """For each toxic text its runs of byte n-grams that occur in LEAST toxic texts or more, at LIFT times the rate of ordinary
    texts or more and SURE Poisson deviations above that rate: a rare gram of any share counts, one by chance does not."""
    grams = lambda b: [b[i : i + GRAM] for i in range(len(b) - GRAM + 1)]
    texts: Counter = Counter()
    for t in toxic:
        texts.update(set(grams(t)))
    often = {g for g, n in texts.items() if n >= LEAST}
    seen, other = Counter(), Counter()
    for counts, group in ((seen, toxic), (other, ordinary)):
        for t in group:
            counts.update(g for g in grams(t) if g in often)
    per = sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    own = {g for g, n in seen.items() if n >= LIFT * per * (other[g] + 1) and n - per * other[g] >= SURE * (per * other[g] + 1) ** 0.5}
    out, uses = [], Counter()
    for t in toxic:
        runs, end = [], -1
        for i, g in enumerate(grams(t)):
            if g in own:
                if i <= end:
                    runs[-1] += t[end : i + GRAM]
                else:
                    runs.append(t[i : i + GRAM])
                end = i + GRAM
        uses.update(runs)
        out.append(b"".join(r for r in runs if uses[r] <= REPEATS))  # else the commonest language takes up the dictionary
    return out


def _dictionary(samples: list[bytes], size: int, k: int = 0) -> bytes:
    """Content of a dictionary trained on samples; the samples themselves where they are too few to train on."""
    import zstandard as z

    samples = [s for s in samples if len(s) >= 8]
    try:
        more = {"k": k, "d": 6} if k else {}
        return z.train_dictionary(size, samples, **more).as_bytes()[-size:]
    except (z.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def train(texts: list[str], toxic: list[int]) -> Model:
    """Dictionaries and calibration of labelled texts."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    bad, good = [t for t, y in zip(raw, toxic, strict=True) if y], [t for t, y in zip(raw, toxic, strict=True) if not y]
    flat = np.zeros(0)
    segments = _segments(bad, good) if bad and good else []
    if not any(segments):
        return Model(b"", None, flat, flat, np.asarray([len(bad) / len(raw) if raw else 0.0]))
    windows = [t[i : i + 256] for t in good for i in range(0, len(t), 256)]
    model = Model(_dictionary(windows, ORDINARY_BYTES), _dictionary(segments, TOXIC_BYTES, 16), flat, flat, flat)
    y = np.asarray([1.0] * len(bad) + [0.0] * len(good))
    x = model.distances(bad + good)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):  # ridge logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.5 * w)
    return Model(model.ordinary, model.toxic, mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled texts outside the held-out fold."""
    common.ready(docs.sparkSession)

    def run(batches):
        common.hold()
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(1).to_pylist()
            toxic += batch.column(0).to_pylist()
        m = train(texts, toxic)
        del texts, toxic
        common.trim()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (m.ordinary, m.toxic, m.mean.tobytes(), m.scale.tobytes(), m.weights.tobytes())], names=["ordinary", "toxic", "mean", "scale", "weights"])

    labelled = common.labelled_sample(docs, labels, ["toxic"], sample).select("doc_id", F.coalesce(F.col("toxic"), F.lit(0)).cast("int").alias("toxic"), "text")
    got = common.in_one_task(labelled, "doc_id").select("toxic", "text").mapInArrow(run, "ordinary binary, toxic binary, mean binary, scale binary, weights binary").collect()
    if not got:  # Spark may leave out a task that has no rows
        return train([], [])
    (r,) = got
    return Model(bytes(r.ordinary), None if r.toxic is None else bytes(r.toxic), *(np.frombuffer(x, np.float64) for x in (r.mean, r.scale, r.weights)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    common.ready(docs.sparkSession)

    def run(batches):
        common.hold()
        for batch in batches:
            for part in common.pieces(batch):
                s = model.score([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(common.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def select(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under below."""
    common.ready(docs.sparkSession)

    def run(batches):
        common.hold()
        for batch in batches:
            for part in common.pieces(batch):
                texts = [t or b"" for t in part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(model.score(texts) < below))

    return docs.mapInArrow(run, docs.schema)
