"""Chunks of text that tokenize apart, and values of whole texts from those of their distinct chunks (operators 3, 4 and 8).

The pattern of these byte-level vocabularies lets a blank begin a match but never follow other text inside one, so wherever a
blank follows a non-blank there is a boundary of matches, and also where a mark follows a letter. A text split there gives
the same ids as the whole. Chunks are cut, hashed and made distinct with NumPy over the bytes of many texts at once; each distinct
chunk is then encoded once per worker, and texts are put together again by indices.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import textvec


def cuts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks of the texts begin: at each text, at an ASCII blank after a non-blank, at an ASCII mark after a letter.

    A byte above 0x7F before a blank counts as a non-blank unless it may end one of Unicode's blanks; control characters
    cut nothing.
    """
    n = len(raw)
    at = np.zeros(n, dtype=bool)
    if n > 1:
        before, here = raw[:-1], raw[1:]
        blank = (here == 32) | (here - np.uint8(9) < 5)
        letter = (before | np.uint8(32)) - np.uint8(97) < 26
        plain = (before > 32) & (before < 127)
        wide = before > 127
        if wide.any():
            # U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F and 3000 end with one of these bytes.
            last = (before - np.uint8(0x80) <= 0x0A) | (before == 0xA0) | (before == 0xA8) | (before == 0xA9) | (before == 0xAF) | (before == 0x9F)
            two = np.concatenate([[0], raw[:-2]]).astype(np.uint8)
            plain |= wide & ~(last & ((two == 0xC2) | (two < 0xC0)))
            letter |= wide & (two == 0xC3) & (before != 0x97) & (before != 0xB7)
        mark = (here - np.uint8(33) < 94) & ~(here - np.uint8(48) < 10) & ~((here | np.uint8(32)) - np.uint8(97) < 26)
        at[1:] = (blank & plain) | (mark & letter)
    first = bounds[:-1]
    at[first[first < n]] = True
    return np.flatnonzero(at)


#: _MASKS[n] keeps the first n bytes of a little-endian 64-bit number.
_MASKS = np.asarray([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Distinct:
    """The distinct chunks of some texts: keys (their bytes), of (the key of each chunk) and first (chunks before each text).

    Chunks of up to 16 bytes are two 64-bit numbers and a length, which are hashed and, as equal hashes must be equal chunks,
    compared; longer ones are few for their bytes and go by a dictionary.
    """

    def __init__(self, texts: pa.Array):
        raw, bounds = textvec.flat(texts)
        starts = cuts(raw, bounds)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        self.first = np.searchsorted(starts, bounds)
        data = raw.tobytes()
        long_ = np.flatnonzero(ends - starts > 16)
        short = np.flatnonzero(ends - starts <= 16) if len(long_) else slice(None)
        at, of = self._short(raw, starts[short], (ends - starts)[short])
        a, b = starts[short][at], ends[short][at]
        self.keys = [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        self.of = of
        if len(long_):
            more: dict[bytes, int] = {}
            self.of = np.empty(len(starts), np.int64)
            self.of[short] = of
            self.of[long_] = [more.setdefault(data[x:y], len(self.keys) + len(more)) for x, y in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True)]
            self.keys += more

    @staticmethod
    def _short(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first chunk of each kind and the kind of each chunk."""
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        numbers = np.ndarray((len(raw) + 8,), "<u8", padded, strides=(1,))
        x = numbers[starts] & _MASKS[np.minimum(lengths, 8)]
        y = numbers[starts + 8] & _MASKS[np.clip(lengths - 8, 0, 8)]
        with np.errstate(over="ignore"):
            h = textvec.mix(x + np.uint64(0x9E3779B97F4A7C15) * textvec.mix(y + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        found = pa.array(h).dictionary_encode()
        of = np.asarray(found.indices)
        at = np.empty(len(found.dictionary), np.int64)
        at[of[::-1]] = np.arange(len(h) - 1, -1, -1)
        if (x == x[at][of]).all() and (y == y[at][of]).all() and (lengths == lengths[at][of]).all():
            return at, of
        _, at, of = np.unique(np.stack([x, y, lengths.astype(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
        return at, of

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its chunks' values."""
        total = np.concatenate([[0], np.cumsum(values[self.of])])
        return np.diff(total[self.first])

    def joined(self, values: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' values (arrays of kind as bytes) after each other, and each text's bounds in them."""
        width = np.dtype(kind).itemsize
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
        flat = ragged(np.frombuffer(b"".join(values), kind), sizes, self.of)
        total = np.concatenate([[0], np.cumsum(sizes[self.of])])
        return flat, total[self.first]


def ragged(flat: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The rows of a ragged table (values, sizes of its rows) named by of, after each other."""
    own = sizes[of]
    total = int(own.sum())
    begin = (np.cumsum(sizes) - sizes)[of] - (np.cumsum(own) - own)
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    index = np.repeat(begin.astype(kind), own)
    index += np.arange(total, dtype=kind)
    return flat[index]


class Cache:
    """Values of chunks by a batch function, in two generations of at most most chunks: bounded memory, same results.

    When the young generation is full it becomes the old one, and the old one goes; what is used comes back to the young.
    Values of chunks of over longest bytes are not held.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = 200_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, keys: list[bytes]) -> list:
        """The values of distinct keys; new ones are encoded together."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = [young.get(k) for k in keys]
        lost = [i for i, v in enumerate(out) if v is None]
        new = []
        for i in lost:
            if (v := old.get(keys[i])) is None:
                new.append(i)
            else:
                out[i] = young[keys[i]] = v
        if new:
            for i, v in zip(new, self.encode([keys[i] for i in new]), strict=True):
                out[i] = v
                if len(keys[i]) <= self.longest:
                    young[keys[i]] = v
        return out


class Joined:
    """Encodes many chunks by few calls of the tokenizers library.

    Chunks that begin with a blank and end with a non-blank are put after each other: the result is a text with just these
    chunks, so the library's ids of it are theirs in order, and the tokens' byte lengths tell where each chunk ends.
    """

    def __init__(self, path: str, most: int = 1 << 16):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.top = max(vocab.values())
        self.lengths = np.zeros(self.top + 1, np.int64)
        for token, i in vocab.items():  # a byte-level token has one character for each byte
            self.lengths[i] = len(token)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.begins = b"".join(a[:1] + a[-1:] for a in self.added)

    def ids(self, texts: list[str]) -> list[list[int]]:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [x.ids for x in fast(texts, add_special_tokens=False)]

    def __call__(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk (not empty), as little-endian 32-bit integers.

        Alone go chunks that may not follow another one, or that hold a byte which begins or ends a special token.
        """
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes) - sizes
        last = raw[starts + sizes - 1]
        follows = (raw[starts] == 32) & (last > 32) & (last < 127) & ~np.logical_or.reduceat(np.isin(raw, np.frombuffer(self.begins, np.uint8)), starts)
        out: list = [None] * len(chunks)
        alone = np.flatnonzero(~follows).tolist()
        for i, x in zip(alone, self.ids([chunks[i].decode() for i in alone]), strict=True):
            out[i] = np.asarray(x, "<u4").tobytes()
        run = np.flatnonzero(follows)
        for own in np.split(run, np.flatnonzero(np.diff(np.cumsum(sizes[run]) // self.most)) + 1):
            if len(own):
                own = own.tolist()
                ids = np.asarray(self.ids([b"".join([chunks[i] for i in own]).decode()])[0], "<u4")
                ends = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes[own])) + 4).tolist()
                data = ids.tobytes()
                for i, a, b in zip(own, [0, *ends], ends, strict=False):
                    out[i] = data[a:b]
        return out
