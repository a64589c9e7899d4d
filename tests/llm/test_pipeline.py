"""The pipeline's stages on a small table: schemas, decisions that take effect, and agreement with the operators."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from leafwright.llm import mixing


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema, counts = docs.schema, [docs.count()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != P.STAGES[-1][0]:
            assert out.schema == schema
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "near_dedup":
            assert docs.count() == docs.select("doc_id").distinct().count() < before.count()
        if name == "mixing":
            words = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
            assert abs(words(docs) - 1.5 * words(before)) <= 25
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]


def test_repeated_and_null_ids(spark, sf_dir):
    t = " ".join(f"w{i}" for i in range(50))
    d = spark.createDataFrame([(1, t, "en", "s", 0), (1, t, "en", "s", 0), (2, t, "en", "s", 0), (None, "x", "en", "s", 0), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.one_of_each_group(spark, d, sf_dir).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 3]
