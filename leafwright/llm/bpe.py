"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition (operator 4).

The rank file's vocabulary is a merge table: a row (l, r, m) for every way to split token m into two tokens. The distinct
matches of the pattern in a batch become token-position rows of their bytes, each with the place and token of the row that follows it
and, joined from the merge table, the rank of the pair of both. Every step of one recursive query contracts each word's leftmost pair of
least rank and joins the two pairs that this changes with the merge table again, until no word has a pair. Words of up to SHORT bytes,
nearly all, hand their rows from step to step until they are done, which needs no key; their states of all steps are SHORT / 2 rows a
byte at most. For longer words the recursion is keyed by place, so it keeps each row's newest state only: memory is in proportion to
the bytes, time to the square of a word's length. Ordered aggregation then gives a word's ids and decodes them to bytes. A document's
ids are those of its matches in order.

Chunks of text seen before are taken from a bounded cache of the worker. Null texts are empty; they have no ids. Very long texts are
encoded whole, a piece of a batch each. Rows pass through one by one: repeated rows, ties, null ids and empty tables need no care,
and further columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokenize import Cache, Distinct

#: Bytes of the words that one query takes, of long and of short ones, and the bytes of a short one (255 at most, as _SHORT packs places).
BYTES_EACH, BYTES_SHORT, SHORT = 40_000, 100_000, 32
#: Chunks of one generation of a worker's cache, each of about 190 bytes.
CHUNKS_HELD = 400_000

#: A row's key p is the word's number and the row's place in it; next is the key of the row that follows, after its token, c the rank
#: and place of the pair of both in one number (null: no pair). Rows that are contracted into the one before have no token.
_STEP = """
WITH RECURSIVE s(p, tok, next, after, c) USING KEY (p) AS (
  SELECT start.p, tok, next, after, (m << 32) | (start.p & 4294967295) FROM start LEFT JOIN merges ON pair = (tok << 20 | after)
  UNION
  (WITH live AS MATERIALIZED (SELECT * FROM recurring.s WHERE tok IS NOT NULL),
  best AS (SELECT p >> 32 AS w, min(c) AS c FROM live WHERE c IS NOT NULL GROUP BY 1),
  won AS MATERIALIZED (SELECT (w << 32) | (c & 4294967295) AS p, c >> 32 AS m FROM best),
  pair AS MATERIALIZED (SELECT won.p, m, a.next AS q FROM won JOIN live a ON a.p = won.p),
  changed AS (
    SELECT pair.p, m AS tok, b.next, b.after FROM pair JOIN live b ON b.p = q
    UNION ALL SELECT b.p, b.tok, b.next, m FROM pair JOIN live b ON b.next = pair.p)
  SELECT p, tok, next, after, (m << 32) | (p & 4294967295) FROM changed LEFT JOIN merges ON merges.pair = (tok << 20 | after)
  UNION ALL SELECT q, NULL, NULL, NULL, NULL FROM pair)
)
SELECT p >> 32 AS word, list(tok::INTEGER ORDER BY p) AS ids, string_agg(t.hex, '' ORDER BY p) AS hex
FROM s JOIN tokens t ON t.id = s.tok GROUP BY 1 ORDER BY 1
"""

#: The same for short words, a row each token: w and i are the word and the place of the token's last byte, next is the next row's place,
#: c packs the rank and both places. The second of a contracted pair takes the token, so a row changes by its word's pair alone.
_SHORT = """
WITH RECURSIVE s(w, i, tok, next, after, c, n) AS (
  SELECT w, i, tok, next, after, (m << 16) | (i << 8) | next, 0 FROM start LEFT JOIN merges ON pair = (tok::BIGINT << 20 | after)
  UNION ALL
  (WITH best AS MATERIALIZED (
    SELECT w, (low >> 16)::INTEGER AS m, ((low >> 8) & 255)::INTEGER AS p, (low & 255)::INTEGER AS q
    FROM (SELECT w, min(c) AS low FROM s GROUP BY w) WHERE low IS NOT NULL),
  moved AS (
    SELECT s.w, i, CASE WHEN i = q THEN m ELSE tok END AS tok, CASE WHEN next = p THEN q ELSE next END AS next, CASE WHEN next = p THEN m ELSE after END AS after,
      CASE WHEN i = q OR next = p THEN NULL ELSE c END AS c, n + 1 AS n, i = q OR next = p AS fresh
    FROM s JOIN best ON s.w = best.w WHERE i <> p)
  SELECT w, i, tok, next, after, coalesce(c, (m << 16) | (i << 8) | next), n FROM moved LEFT JOIN merges ON pair = CASE WHEN fresh THEN tok::BIGINT << 20 | after END)
)
SELECT w AS word, list(tok ORDER BY i) AS ids, string_agg(t.hex, '' ORDER BY i) AS hex
FROM s JOIN (SELECT w, max(n) AS n FROM s GROUP BY w) AS newest USING (w, n) JOIN tokens t ON t.id = s.tok GROUP BY w ORDER BY w
"""
_INTEGERS = pa.schema([(c, pa.int32()) for c in ("w", "i", "tok", "next", "after")])


class Bpe:
    """The encoder of one worker: ids and decoded bytes of words."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = np.asarray([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        rows = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        parts = pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate("lrm")})  # noqa: F841
        tokens = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT (l << 20) | r AS pair, m FROM parts")
        self.db.execute("CREATE TABLE tokens AS FROM tokens")
        self.cache = Cache(self.encode_chunks, most=CHUNKS_HELD)

    def encode_words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each word its ids (little-endian 32-bit) and the bytes these decode to."""
        out: list = [(b"", b"")] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")  # words of like length take as many steps
        long_ = lengths[order] > SHORT
        parts = np.where(long_, np.cumsum(lengths[order] * long_) // BYTES_EACH, -1 - np.cumsum(lengths[order]) // BYTES_SHORT)
        for own in np.split(order, np.flatnonzero(np.diff(parts)) + 1):
            sizes = lengths[own]
            if not sizes.sum():
                continue
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            word = np.repeat(np.arange(len(own)), sizes)
            tok = self.single[np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8)]
            last = place == np.repeat(sizes, sizes) - 1
            after = pa.array(np.append(tok[1:], 0), mask=last)
            if sizes[-1] <= SHORT:
                start = pa.table({"w": word, "i": place, "tok": tok, "next": pa.array(place + 1, mask=last), "after": after}).cast(_INTEGERS)
            else:
                p = (word << 32) | place
                start = pa.table({"p": p, "tok": tok, "next": pa.array(p + 1, mask=last), "after": after})  # noqa: F841
            got = self.db.sql(_SHORT if sizes[-1] <= SHORT else _STEP).to_arrow_table()
            ids = got["ids"].combine_chunks()
            data, at = np.asarray(ids.values).astype("<u4").tobytes(), (4 * np.asarray(ids.offsets)).tolist()
            for i, a, b, h in zip(own[np.asarray(got["word"])].tolist(), at, at[1:], got["hex"].to_pylist(), strict=False):
                decoded = bytes.fromhex(h)
                out[i] = (data[a:b], words[i] if decoded == words[i] else decoded)  # equal bytes are held once
        return out

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes | tuple[bytes, bytes]]:
        """For each chunk its ids; with what they decode to, where that is not the chunk (a tuple each would fill the cache)."""
        found = [self.pattern.findall(c.decode()) for c in chunks]
        number: dict[str, int] = {}
        places = [[number.setdefault(w, len(number)) for w in f] for f in found]
        raw = [w.encode() for w in number]
        for c, p in zip(chunks, places, strict=True):
            if len(p) == 1:
                raw[p[0]] = c  # the chunk is the word: one object for both
        words = self.encode_words(raw)
        whole = [words[p[0]] if len(p) == 1 else (b"".join([words[i][0] for i in p]), b"".join([words[i][1] for i in p])) for p in places]
        return [v[0] if v[1] == c else v for c, v in zip(chunks, whole, strict=True)]

    def encode(self, texts: pa.Array) -> list[tuple[bytes, bytes]]:
        """For each text its ids (little-endian 32-bit) and the bytes they decode to."""
        d = Distinct(texts)
        if not d.keys:
            return [(b"", b"")] * len(texts)
        values = self.cache.look_up(d.keys)
        both = [(v, k) if isinstance(v, bytes) else v for k, v in zip(d.keys, values, strict=True)]
        (ids, a), (raw, b) = d.joined([v[0] for v in both], "<u4"), d.joined([v[1] for v in both], np.uint8)
        ids, raw, a, b = ids.tobytes(), raw.tobytes(), (4 * a).tolist(), b.tolist()
        return [(ids[a[i] : a[i + 1]], raw[b[i] : b[i + 1]]) for i in range(len(texts))]


_bpe: dict[tuple, Bpe] = {}


def worker_bpe(path: str, pattern: str) -> Bpe:
    common.hold("bpe", _bpe.clear)
    if (path, pattern) not in _bpe:
        _bpe[path, pattern] = Bpe(path, pattern)
    return _bpe[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) of each row of docs (doc_id, text)."""
    common.ready(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            for part in common.pieces(batch):
                got = bpe.encode(part.column(1))
                sha = lambda k: [hashlib.sha256(x[k]).hexdigest() for x in got]  # noqa: B023, E731
                cols = [part.column(0), pa.array([len(x[0]) // 4 for x in got], pa.int64()), pa.array(sha(0), pa.string()), pa.array(sha(1), pa.string())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x[0], "<i4") for x in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
