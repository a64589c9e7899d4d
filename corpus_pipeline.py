"""The corpus pipeline: documents in, encoded training documents out.

STAGES are applied in order; each reads the table that the one before has written and works on all of its rows. The quality and
toxicity classifiers drop what they reject, near-duplicates keep one document of each group (five-word shingles, similarity
0.8), mixing brings the sources to their target weights, and byte-level BPE encodes what is left.

Null and empty texts pass the filters as the models score them (features of an empty text) and take no part in the mix, as
they have no words. Rows with a null id are kept by the near-duplicate stage; rows equal in id and text are one document there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafwright.llm import bpe, common, mixing, near_dedup, quality, toxicity
from leafwright.llm.queries import MULTI, pattern


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of at least the first good grade is 0.5 or more."""
    return quality.select(docs, quality.fit(docs, quality.grades(_labels(spark, sf_dir))))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return toxicity.select(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near-duplicates; rows with one id and unlike texts are in groups of their own."""
    return near_dedup.distinct_documents(docs, width=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, once for each pass."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of each document."""
    return bpe.encode(docs, common.tokenizer_file(MULTI), pattern())


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_dedup", one_of_each_group), ("mixing", mixed), ("byte_bpe", encoded)]

#: SQL can express neither the classifiers nor the encoder; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    where = common.scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), where, name)
    return STAGES[-1][1](spark, docs, sf_dir)
