"""The registered queries of the operators, one opN_<name> each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, fingerprints, media, mixing, near_dedup, quality, token_counts, token_files, toxicity, warc

MULTI = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes on two-word shingles, similarity 0.8 or more."""
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), width=2)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, quality.grades(_read(spark, sf_dir, "labels"))))


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its sums for every context limit."""
    counted = token_counts.lengths(_read(spark, sf_dir, "documents"), common.tokenizer_file("byte_bpe_50k.tiktoken"), pattern())
    return token_counts.histogram(counted)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    return bpe.encode(_read(spark, sf_dir, "documents"), common.tokenizer_file(MULTI), pattern(), with_ids=False)


def op5_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by compression distance."""
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op6_lempel_ziv_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprints.compare(_read(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.taken(_read(spark, sf_dir, "documents"))


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to wavelet matrix files and read back."""
    manifest = token_files.write(_read(spark, sf_dir, "documents"), common.tokenizer_file("byte_bpe_50k.json"), common.scratch(spark))
    return token_files.read(manifest)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back."""
    return warc.read(warc.write(_read(spark, sf_dir, "pages"), common.scratch(spark)))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit audio, read back, with features."""
    where = common.scratch(spark)
    return media.features(media.store(_read(spark, sf_dir, "documents"), where), where)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ordinal_quality, op2_minhash_near_dedup, op3_length_histogram, op4_byte_bpe, op5_zstd_toxicity, op6_lempel_ziv_fingerprints, op7_mix_sources, op8_wavelet_tokens, op9_warc, op10_audio_features, pipeline)}


#: DuckDB SQL where SQL can express a query.
OP2_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1
    UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, c) AS (SELECT a, a FROM sym UNION SELECT sym.b, reach.c FROM reach JOIN sym ON sym.a = reach.id),
least AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, d.doc_id = coalesce(l.c, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.id = d.doc_id
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY sha256(html)) AS least FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND least <> page_id THEN least END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2_SQL, "op9_warc": OP9_SQL}
