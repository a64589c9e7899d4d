"""Lempel-Ziv phrase fingerprints (operator 6).

A text's code points are parsed into phrases as LZ78 does: each phrase is the shortest run that is not a phrase yet. The set of
phrases says what a dictionary compressor learns from the text; texts with like sets compress well together. Each phrase is
hashed, and the least value under each of FUNCTIONS hash functions makes the fingerprint (16 bits of each, in hex). The share
of equal places of two fingerprints estimates the similarity of the phrase sets, so the likeness of compression.

A parse is a running state, so a text and a text that shares its beginning share the parse and the minima of it. Null texts are empty and
have a fingerprint of their own (no phrase); a text's last, unfinished phrase counts as one. Equal texts have equal
fingerprints. Texts of any length are parsed whole, code point by code point.

The next document (ascending doc_id, nulls first, equal ids by a hash of the text; after the last the first) follows a document in
the task of its range, after one shuffle by (doc_id, hash), which splits an id that many rows have. Each range's last document meets
the first one of the next range in a table of two rows a range. Repeated rows are each other's next documents; ties in id are
broken by the hash; an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textvec

FUNCTIONS = 64


class Parse:
    """The phrases of a text so far, those that are new since the last fork, and the unfinished one (always a phrase already)."""

    __slots__ = ("seen", "new", "open")

    def __init__(self, seen: set | None = None, rest: str = ""):
        self.seen, self.new, self.open = set() if seen is None else seen, [], rest

    def feed(self, text: str) -> Parse:
        seen, w = self.seen, self.open
        add, found = seen.add, self.new.append
        for c in text:
            w += c
            if w not in seen:
                add(w)
                found(w)
                w = ""
        self.open = w
        return self

    def fork(self) -> Parse:
        """A parse that goes on from here by itself."""
        return Parse(self.seen.copy(), self.open)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240608))
    return rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)


_MOST = np.iinfo(np.uint64).max


def minima(phrases, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash of the phrases under each function."""
    least = np.full(FUNCTIONS, _MOST, np.uint64)
    if not phrases:
        return least
    raw = [p.encode("utf-8", "surrogatepass") for p in phrases]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    with np.errstate(over="ignore"):
        h = textvec.word_hashes(flat, np.concatenate([[0], ends[:-1]]), ends, lower=False)
        for i in range(0, len(h), 2048):
            x = h[None, i : i + 2048] * a[:, None] + b[:, None]
            np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=1), out=least)
    return least


def finish(least: np.ndarray) -> np.ndarray:
    """16 bits of each minimum; 0 for no phrase."""
    if least[0] == _MOST and (least == _MOST).all():
        return np.zeros(FUNCTIONS, np.uint16)
    with np.errstate(over="ignore"):
        return (textvec.mix(least) >> np.uint64(48)).astype(np.uint16)


def signature(phrases, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return finish(minima(phrases, a, b))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.count_nonzero(x == y)) / FUNCTIONS


def _hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of docs (doc_id, text)."""
    common.ready(docs.sparkSession)

    def run(batches):
        a, b = _functions()
        for batch in batches:
            out = [_hex(signature(Parse().feed(t or "").new, a, b)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


class _Row:
    """A document with its parse and minima, and what its edited text keeps of them."""

    __slots__ = ("doc", "text", "sig", "kept", "edited", "least")

    def __init__(self, doc, text: str, a: np.ndarray, b: np.ndarray):
        self.doc, self.text = doc, text
        self.kept = text[: len(text) - len(text) // 2]
        parse = Parse().feed(self.kept)
        self.least, self.edited = minima(parse.new, a, b), parse.fork()
        parse.new = []
        self.sig = finish(np.minimum(self.least, minima(parse.feed(text[len(self.kept) :]).new, a, b)))

    def compared(self, after: _Row, a: np.ndarray, b: np.ndarray) -> tuple:
        """The row of the result, with the document that follows."""
        put = after.text[: len(self.text) // 2]
        e = finish(np.minimum(self.least, minima(self.edited.feed(put).new, a, b)))
        digest = hashlib.sha256((self.kept + put).encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc, len(self.text), digest, _hex(self.sig), _hex(e), likeness(self.sig, e), likeness(self.sig, after.sig)


def compare(docs: DataFrame, rows_each: int = 1000) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to the edited text and to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    """
    common.ready(docs.sparkSession)
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        a, b = _functions()
        part, last = TaskContext.get().partitionId(), None

        def out(rows, kind: int, text=None):
            n = len(rows)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([text] * n, pa.string()), *cols], names=["part", "kind", "text", *_NAMES])

        bare = lambda r: [(r.doc, None, None, None, None, None, None)]
        for batch in batches:
            done = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = _Row(doc, text, a, b)
                if last is None:
                    yield out(bare(row), 1, text)
                else:
                    done.append(last.compared(row, a, b))
                last = row
            if done:
                yield out(done, 0)
        if last is not None:
            yield out(bare(last), 2, last.text)

    ranged = common.ranged(t, [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")], rows_each)
    found = common.save(ranged.mapInArrow(run, "part long, kind int, text string, " + _OUT), common.scratch(docs.sparkSession), "compared")
    order = Window.orderBy("part")
    parts = found.where("kind = 1").select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order)).alias("next"))
    firsts = found.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("after"))
    ends = found.where("kind = 2").join(following, "part").join(firsts, "next").select("doc_id", "text", "after")

    def close(batches):
        a, b = _functions()
        for batch in batches:
            rows = [_Row(doc, text, a, b).compared(_Row(None, after, a, b), a, b) for doc, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return found.where("kind = 0").select(*_NAMES).union(ends.mapInArrow(close, _OUT))
