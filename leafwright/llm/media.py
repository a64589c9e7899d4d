"""Audio columns and their features (operator 10).

A payload is stored as the samples of a WAV file (8 bits, mono, RATE), so it comes back byte for byte. Features of the samples
read back: polyphase resampling by UP / DOWN, log-mel energies of overlapping Hann windows, and segments by hysteresis on the
frames' energy (one begins above HIGH dB over the mean and ends below LOW). The mel frames are cut into tensors of one fixed
shape (FRAMES x MELS, the last one filled up) with time spans and stored as fixed-shape Arrow tensors in IPC files.

Audio of any length is worked through in blocks of FRAMES frames, the same for every text, so equal payloads give equal
values whatever stands beside them and memory is bounded. Null texts are empty: their payload is all padding; very long texts take a
few times their bytes as samples and nothing more as features. Rows pass one by one: repeated rows, ties and null ids keep their
rows, an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

RATE, UP, DOWN = 24_000, 2, 3
UNIT = 192
FRAMES, MELS, FFT, HOP = 64, 24, 256, 128
HIGH, LOW = 1.5, -1.5
TAPS = 16


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes padded with blanks to a positive multiple of unit."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b" ")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(samples) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)


def from_wav(data: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono WAV file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAV file")
    size, kind, channels, rate, _, _, bits = struct.unpack("<IHHIIHH", data[16:36])
    at = 20 + size
    while data[at : at + 4] != b"data":
        at += 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
    if (kind, channels, bits) != (1, 1, 8):
        raise ValueError("not 8-bit mono PCM")
    n = struct.unpack("<I", data[at + 4 : at + 8])[0]
    return data[at + 8 : at + 8 + n], rate


def _filters() -> np.ndarray:
    """The UP branches (TAPS each) of a windowed-sinc low-pass for resampling by UP / DOWN."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    h *= UP / h.sum()
    return np.stack([h[p::UP][::-1] for p in range(UP)]).astype(np.float32)


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)
    up, down = (f[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


_FILTERS, _BANK, _WINDOW = _filters(), _mel_bank(RATE * UP / DOWN), np.hanning(FFT).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling: output sample m uses branch (m * DOWN) mod UP at input (m * DOWN) div UP."""
    n = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n, np.float32)
    for r in range(UP):
        m = np.arange(r, n, UP)
        if len(m):
            out[r::UP] = windows[(m[0] * DOWN) // UP :: DOWN][: len(m)] @ _FILTERS[(r * DOWN) % UP]
    return out


def log_mel(samples: bytes):
    """Blocks of FRAMES x MELS log energies and the number of frames in each, over the whole audio."""
    raw = np.frombuffer(samples, np.uint8)
    per_frame = HOP * DOWN // UP
    frames = max(1, len(raw) // per_frame)
    lead, tail = TAPS * 2 - TAPS * 2 % DOWN, (FFT - HOP) * DOWN // UP + 2 * DOWN
    for first in range(0, frames, FRAMES):
        k = min(FRAMES, frames - first)
        a, b = first * per_frame - lead, (first + FRAMES) * per_frame + tail
        x = np.zeros(b - a, np.float32)
        part = raw[max(0, a) : b]
        x[max(0, -a) : max(0, -a) + len(part)] = (part.astype(np.float32) - 128) / 128
        y = resample(x)[lead * UP // DOWN :]
        cut = np.lib.stride_tricks.sliding_window_view(y, FFT)[::HOP][:FRAMES]
        power = np.abs(np.fft.rfft(cut * _WINDOW, axis=1)) ** 2
        block = np.log(power.astype(np.float32) @ _BANK + 1e-6)
        block[k:] = np.float32(np.log(1e-6))
        yield block, k


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Frame spans that begin above high and last until the energy is below low (dB over the mean)."""
    e = energy - energy.mean()
    mark = np.where(e > high, 1, np.where(e < low, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(e)), -1))
    on = np.concatenate([[0], np.where(last >= 0, mark[last], 0), [0]])
    return list(zip(np.flatnonzero(np.diff(on) == 1).tolist(), np.flatnonzero(np.diff(on) == -1).tolist(), strict=True))


def store(docs: DataFrame, where: str) -> DataFrame:
    """doc_id, n_bytes, media (WAV bytes) of each row of docs (doc_id, text), written below where and read again."""
    common.ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    made.write.option("compression", "zstd").parquet(f"{where}/media")
    return docs.sparkSession.read.schema(made.schema).parquet(f"{where}/media")


def _tensor_file(rows: list) -> bytes:
    """An Arrow IPC file: doc_id, t0_ms, t1_ms and mel, a fixed-shape tensor column."""
    kind = pa.fixed_shape_tensor(pa.float16(), [FRAMES, MELS], dim_names=["frame", "mel"])
    flat = pa.array(np.concatenate([r[3].reshape(-1) for r in rows]), pa.float16())
    mel = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS))
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "t0_ms": pa.array([r[1] for r in rows], pa.float64()), "t1_ms": pa.array([r[2] for r in rows], pa.float64()), "mel": mel})
    sink = io.BytesIO()
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_table(table)
    return sink.getvalue()


def features(media: DataFrame, folder: str, tensors_each: int = 2000) -> DataFrame:
    """Read stored media back: sizes, digests, a feature string, the segments' time spans and the place of the tensors of each.

    Writes tensor files below folder/tensors and the result below folder/features; tensor_file and tensor_row name a row's first
    tensor, and those that follow are the next rows, on in the next file (manifest lists the files).
    """
    common.ready(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments", "tensor_file", "tensor_row"]
    spans_type = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans_type, pa.string(), pa.int64()]

    def run(batches):
        from pyspark import TaskContext

        task, seq, held = TaskContext.get().partitionId(), 0, []
        ms = 1000 * HOP / (RATE * UP / DOWN)
        uri = lambda: f"{folder}/tensors/{task:08d}-{seq:06d}.arrow"
        for batch in batches:
            rows = []
            for doc, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                samples, _ = from_wav(data)
                digest, energy, frames, at = hashlib.sha256(), [], 0, (uri(), len(held))
                for block, k in log_mel(samples):
                    tensor = np.round(block, 1).astype(np.float16)
                    digest.update(tensor.tobytes())
                    energy.append((10 / np.log(10)) * block[:k].mean(axis=1))
                    held.append((doc, frames * ms, (frames + k) * ms, tensor))
                    frames += k
                    if len(held) >= tensors_each:
                        files.write(uri(), _tensor_file(held))
                        seq, held = seq + 1, []
                spans = segments(np.concatenate(energy))
                active = sum(b - a for a, b in spans)
                feature = f"frames={frames};segments={len(spans)};active_ms={active * ms:g};mel={digest.hexdigest()[:32]}"
                times = [{"start_ms": a * ms, "end_ms": b * ms} for a, b in spans]
                rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, times, *at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if held:
            files.write(uri(), _tensor_file(held))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments array<struct<start_ms double, end_ms double>>, tensor_file string, tensor_row long"
    return common.save(media.mapInArrow(run, schema), folder, "features")


def manifest(found: DataFrame) -> DataFrame:
    """tensor_file and n_docs (documents whose tensors begin in it) of the tensor files that the result of features names."""
    return found.groupBy("tensor_file").agg(F.count("*").alias("n_docs"))


def read_tensors(data: bytes) -> pa.Table:
    """The table of a tensor file; mel is a fixed-shape tensor column (to_numpy_ndarray gives one array)."""
    return pa.ipc.open_file(io.BytesIO(data)).read_all()
