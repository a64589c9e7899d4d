"""Chunks are boundaries of the pattern's matches, whatever the text."""

import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from leafwright.llm.queries import pattern
from leafwright.llm.tokenize import Cache, Distinct, ragged

PARTS = [" ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "à", "É", "†", "a", "Bc", "é", "ß", "×", "÷", "²", "ſ", "中", "👍", "1", "_", "-", "'", "'s", "'ll", "llama", "!", "...", "<|"]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=4))
def test_boundaries(texts):
    found = regex.compile(pattern()).findall
    d = Distinct(pa.array(texts, pa.string()))
    each = [[d.keys[k].decode() for k in d.of[a:b]] for a, b in zip(d.first, d.first[1:])]
    assert ["".join(c) for c in each] == texts and len(set(d.keys)) == len(d.keys)
    assert [[m for c in cs for m in found(c)] for cs in each] == [found(t) for t in texts]


def test_rows_are_put_together():
    d = Distinct(pa.array(["a b a", None, "", "b"]))
    flat, bounds = d.joined([k * 2 for k in d.keys], np.uint8)
    assert bytes(flat) == b"aa b b a abb" and bounds.tolist() == [0, 10, 10, 10, 12]
    assert d.sums(np.asarray([len(k) for k in d.keys])).tolist() == [5, 0, 0, 1]
    assert ragged(np.arange(6), np.array([1, 2, 3]), np.array([2, 0, 2])).tolist() == [3, 4, 5, 0, 3, 4, 5]


def test_cache_is_bounded():
    calls = []
    c = Cache(lambda new: [calls.append(x) or len(x) for x in new], most=3, longest=5)
    for _ in range(3):
        assert c.look_up([b"a", b"bb", b"longer-than-five"]) == [1, 2, 16]
    assert calls.count(b"a") == 1 and calls.count(b"longer-than-five") == 3
    c.look_up([str(i).encode() for i in range(50)])
    c.look_up([b"a"])
    c.look_up([b"b"])
    assert len(c.young) + len(c.old) <= 60
