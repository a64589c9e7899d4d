"""Token ids in wavelet matrix files (operator 8).

Documents are encoded in ascending doc_id order, each followed by the id END, and packed into shards of about SHARD_TOKENS ids. A
shard is one compressed file: a bit plane for each bit of an id, from the top bit down, with the ids stably parted by each bit
in turn (a wavelet matrix), and the count of ones before every 512 bits. From the planes and counts, Wavelet answers access (id
at a place), rank and count (of an id before a place), select (place of its n-th occurrence) and gives all ids back. An id has as
many planes as the vocabulary's largest id needs bits.

File format: a JSON header line (format, n, bits, doc ids, starts, sizes), then each plane and each plane's counts, zstd-compressed.
Files get their final name by a rename once they are whole; a manifest table lists them. A range shuffle by (doc_id, hash of the
text) gives each task one range as a stream, so an id that many rows have is split too; document starts come from sums over ranges
and shards in the manifest.

Null texts are empty and have the end id only. Equal ids follow each other by the hash of their texts, null ids come first; repeated rows
are written each. Very long texts are encoded whole; a shard holds at least one document. Further columns, whatever their names, are
not read. No documents, no files.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, files, textvec
from .tokenize import Cache, Distinct, Joined

END = 0
SHARD_TOKENS = 2_000_000
#: Ids that a task reads back, or one file.
READ_TOKENS = 1_000_000
_encoders: dict[str, tuple[Joined, Cache]] = {}


class Wavelet:
    """Rank/select queries on the planes of one shard; ones are each plane's counts of ones before every 512 bits and in all."""

    def __init__(self, planes: list[np.ndarray], n: int, ones: list[np.ndarray] | None = None):
        self.planes, self.n = planes, n
        self.ones = ones if ones is not None else [self._counts(p) for p in planes]
        self.zeros = [n - int(o[-1]) for o in self.ones]

    @staticmethod
    def _counts(plane: np.ndarray) -> np.ndarray:
        whole = np.zeros(-(-len(plane) // 64) * 8, np.uint64)
        whole.view(np.uint8)[: len(plane)] = plane
        return np.concatenate([[0], np.cumsum(np.bitwise_count(whole).reshape(-1, 8).sum(axis=1, dtype=np.int64))])

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> Wavelet:
        """The matrix of ids below 2 ** bits."""
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id does not fit {bits} bits")
        planes, x = [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            on = (x & x.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(on, bitorder="little"))
            x = np.concatenate([x[np.flatnonzero(~on)], x[np.flatnonzero(on)]])
        return Wavelet(planes, len(ids))

    def _rank1(self, level: int, i: int) -> int:
        p, word = self.planes[level], i >> 9
        total = int(self.ones[level][word]) + int(np.bitwise_count(p[word * 64 : i >> 3]).sum(dtype=np.int64))
        return total + (int(p[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            one = self._rank1(level, i)
            i = self.zeros[level] + one if bit else i - one
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """How often value occurs before place i."""
        start = 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, i)
            if value >> (len(self.planes) - 1 - level) & 1:
                start, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, i = start - a, i - b
        return i - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of occurrence k (from 0) of value; -1 if there are fewer."""
        if k >= self.count(value):
            return -1
        lo, hi = 0, self.n
        while lo < hi:  # least i with rank(value, i + 1) > k
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.rank(value, mid + 1) > k else (mid + 1, hi)
        return lo

    def all(self) -> np.ndarray:
        """All ids in order: the parting by each bit undone from the last plane up."""
        x = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for depth, (p, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            on = np.unpackbits(p, count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~on)] = x[:zeros]
            y[np.flatnonzero(on)] = x[zeros:] | x.dtype.type(1 << depth)
            x = y
        return x

    def to_bytes(self, docs: list, starts: list[int]) -> bytes:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        body = [squeeze(x) for p, o in zip(self.planes, self.ones, strict=True) for x in (p.tobytes(), o.astype("<u4").tobytes())]
        head = {"format": "wavelet-matrix-2", "n": self.n, "bits": len(self.planes), "docs": docs, "starts": starts, "sizes": [len(b) for b in body]}
        return json.dumps(head).encode() + b"\n" + b"".join(body)

    @staticmethod
    def from_bytes(data: bytes) -> tuple[Wavelet, list, list[int]]:
        import zstandard

        line = data.index(b"\n")
        head, at, parts = json.loads(data[:line]), line + 1, []
        for size in head["sizes"]:
            parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + size]))
            at += size
        planes, ones = [np.frombuffer(p, np.uint8) for p in parts[::2]], [np.frombuffer(o, "<u4") for o in parts[1::2]]
        return Wavelet(planes, head["n"], ones), head["docs"], head["starts"]


def _encoder(path: str) -> tuple[Joined, Cache]:
    if path not in _encoders:
        j = Joined(path)
        _encoders[path] = j, Cache(j, most=400_000)
    return _encoders[path]


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts after each other, and each text's bounds; a text with a special token's string is encoded as a whole."""
    j, cache = _encoder(path)
    raw, bounds = textvec.flat(texts)
    data = raw.tobytes()
    whole = [i for i in range(len(texts)) if any(a in data[bounds[i] : bounds[i + 1]] for a in j.added)] if any(a in data for a in j.added) else []
    if not whole:
        d = Distinct(texts)
        return d.joined(cache.look_up(d.keys), "<u4") if d.keys else (np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64))
    each = [np.asarray(j.ids([data[a:b].decode()])[0], "<u4") if i in set(whole) else encode_texts(texts.slice(i, 1), path)[0] for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


def with_ends(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id END after each text."""
    out = np.full(len(ids) + len(bounds) - 1, END, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = ids
    return out, bounds + np.arange(len(bounds))


def write(docs: DataFrame, path: str, folder: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shards below folder; returns the manifest (part, seq, docs, tokens, uri), saved there too."""
    common.ready(docs.sparkSession)
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def run(batches):
        from pyspark import TaskContext

        common.hold("token_files", _encoders.clear)

        part, seq, held, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        bits = max(1, _encoder(path)[0].top.bit_length())

        def flush():
            uri = f"{folder}/shards/{part:08d}-{seq:06d}.wm"
            sizes = np.concatenate(parts)
            ids = np.concatenate([x for _, x in held])
            docs_in = [d for ds, _ in held for d in ds]
            files.write(uri, Wavelet.build(ids, bits).to_bytes(docs_in, (np.cumsum(sizes) - sizes).tolist()))
            cols = [pa.array([x], pa.int64()) for x in (part, seq, len(docs_in), len(ids))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([uri])], names=["part", "seq", "docs", "tokens", "uri"])

        for batch in batches:
            for piece in common.pieces(batch, most=4 << 20):
                ids, bounds = with_ends(*encode_texts(piece.column(1), path))
                ends, names = np.diff(bounds), piece.column(0).to_pylist()
                at = 0
                while at < len(names):  # documents up to the one that fills the shard
                    k = min(len(names), int(np.searchsorted(bounds, bounds[at] + shard_tokens - size, "left")))
                    k = max(at + 1, k)
                    held.append((names[at:k], ids[bounds[at] : bounds[k]]))
                    parts.append(ends[at:k])
                    size += int(bounds[k] - bounds[at])
                    at = k
                    if size >= shard_tokens:
                        yield flush()
                        seq, held, parts, size = seq + 1, [], [], 0
        if held:
            yield flush()

    ranges = common.ranges(t, 2000)
    return common.save_manifest(common.ranged(t, keys, 2000, parts=ranges).mapInArrow(run, "part long, seq long, docs long, tokens long, uri string"), ranges, folder)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document from the shards' files."""
    by_part = manifest.groupBy("part").agg(F.sum("tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    own = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("part", "uri", own.alias("own")).join(by_part, "part").select("uri", (F.col("own") + F.col("p")).alias("first"))

    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, docs, starts = Wavelet.from_bytes(files.read(uri))
                ids = w.all().astype("<u4").data
                ends = [*starts[1:], w.n]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.asarray(starts, np.int64) + first), pa.array(np.asarray(ends, np.int64) - np.asarray(starts, np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = common.readers(manifest, "tokens", READ_TOKENS)
    return placed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
