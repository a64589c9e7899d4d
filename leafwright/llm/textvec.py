"""Words and shingles of many texts at once, as 64-bit hashes in NumPy.

A word is a run of bytes outside [\\x20\\x09-\\x0D]; A-Z are lower-cased. A word's hash is a polynomial in its bytes modulo
2**64, taken from prefix sums and then mixed, so one pass over a batch's bytes hashes all words, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for i, p in enumerate((_P, _PINV)):
            a = np.full(m, p, np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    out = _powers[0][:n], _powers[1][:n]
    if len(_powers[0]) > 1 << 22:  # do not hold on to what one very long text needed
        _powers[0] = _powers[1] = np.ones(0, np.uint64)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts after each other, and each text's bounds; null is empty."""
    texts = texts.cast(pa.large_binary()) if pa.types.is_large_binary(texts.type) else texts.cast(pa.string()).cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~BLANK[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = inside[0], inside[-1]
    cut = bounds[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(raw))])
    both = cut[inside[cut - 1] & inside[cut]]  # a word may not run over two texts
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(((LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int):
    """For each text its set of width-word shingles as sorted distinct 64-bit hashes.

    A text with fewer words has its whole word sequence as one shingle; without words the set is empty.
    """
    raw, bounds = flat(texts)
    starts, ends, first = spans(raw, bounds)
    words = word_hashes(raw, starts, ends)
    with np.errstate(over="ignore"):
        for d in range(len(bounds) - 1):
            w = words[first[d] : first[d + 1]]
            n = len(w)
            if not n:
                yield w
                continue
            k = min(width, n)
            h = w[: n - k + 1].copy()
            for j in range(1, k):
                h *= _P
                h += w[j : n - k + 1 + j]
            yield np.unique(mix(h + np.uint64(k)))
