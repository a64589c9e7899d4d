"""Exact token counts through a histogram of encoded lengths (operator 3).

Documents are encoded once and aggregated by length; sums over all lengths at or above (or below) a length then answer, for
every context limit at once, the total of tokens, quantiles and the total after truncation. The histogram, a row a length, is
written once; the running sums are in two levels - sums of blocks of lengths, then sums inside a block - so no task
sees all lengths.

Null and empty texts have length 0; very long texts are counted whole, a piece of a batch each. Repeated rows and ties in length
count each time; other columns (whatever their names) and null ids play no part. An empty table gives an empty histogram.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokenize import Cache, Distinct

#: Lengths of one block of the two-level sums.
BLOCK = 1024
_counters: dict[tuple, Cache] = {}


def _counter(path: str, pattern: str) -> Cache:
    if (path, pattern) not in _counters:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _counters[path, pattern] = Cache(lambda new: [len(enc.encode_ordinary(c.decode())) for c in new], most=200_000)
    return _counters[path, pattern]


def lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens of each row of docs (doc_id, text)."""
    common.ready(docs.sparkSession)

    def run(batches):
        common.hold("token_counts", _counters.clear)
        count = _counter(path, pattern)
        for batch in batches:
            for part in common.pieces(batch, most=4 << 20):
                d = Distinct(part.column(1))
                n = d.sums(np.asarray(count.look_up(d.keys), np.int64)) if d.keys else np.zeros(len(part), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """For each length that occurs: n_docs, its share of the sums and what they answer.

    docs_at_least, tokens_at_least: documents of that length or more, and their tokens. tokens_truncated: all tokens left if
    every document is cut to that length. quantile: the share of documents of that length or less.
    """
    w = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    over = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    h = common.save(h, common.scratch(counted.sparkSession), "histogram")
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t"), F.sum("d").over(Window.partitionBy(F.lit(1))).alias("all_docs"), F.sum("t").over(Window.partitionBy(F.lit(1))).alias("all_tokens"))
    x = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens", (F.col("d") + F.sum("n_docs").over(w)).alias("docs_at_least"), (F.col("t") + F.sum(tokens).over(w)).alias("tokens_at_least")
    )
    return x.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(hist: DataFrame, limit: int | Column) -> DataFrame:
    """One row: tokens left if every document is cut to limit, for any limit (also one that is no document's length)."""
    at = F.lit(limit) if isinstance(limit, int) else limit
    return hist.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), at) * F.col("n_docs")), F.lit(0)).alias("tokens"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share q of the documents does not exceed."""
    return hist.where(F.col("quantile") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))
