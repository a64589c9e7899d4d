"""Readers: page and block tables, text files, JSON states, logs, glossaries, and hooks for external extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.functions import text as X

BLOCKS = "doc_id long, page int, block_idx int, content string, translated string, element_type string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
LAYOUT = "page long, block long, text string, x double, y double, width double, height double, font_size double, is_bold boolean, font_name string"
CACHE = "cache_key string, text string, translated string, language string, model string, created_at double, accessed_at double, access_count long"
JOBS = "id string, input_path string, output_dir string, language string, model string, priority int, status string, progress double, quality double, seq long"
CHECKPOINT = "job_id string, phase string, pages map<string,struct<page:int,complete:boolean,blocks:array<struct<block:int,text:string,complete:boolean>>>>, ts double"
GLOSSARY = "domain string, source_language string, target_language string, version string, terms map<string,string>, never_translate array<string>"
EXTRACTED = "path string, page int, block int, text string, raw_text string, x double, y double, width double, height double, font_size double, is_bold boolean"


def documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files as rows (path, length, content) of a folder, whatever store it is in."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def extract(files: DataFrame, extractor: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """An injected extractor over raw files; it yields rows of EXTRACTED. An error becomes a row without text
    whose raw_text is the message, so one bad file fails no task."""
    names = [f.name for f in T._parse_datatype_string(EXTRACTED).fields]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [{"path": path, **r} for r in extractor(path, content)]
                except Exception as e:  # the hook's own failure is data
                    rows.append({"path": path, "raw_text": f"error: {e}"})
            yield pd.DataFrame(rows, columns=names, dtype="object")

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


def pages_of(texts: DataFrame, separator: str = "\f") -> DataFrame:
    """A row for each page of a text, in order."""
    return texts.select("doc_id", F.posexplode(F.split("text", separator)).alias("page", "text"))


def block_rows(pages: DataFrame) -> DataFrame:
    """Parts between blank lines, trimmed, without U+2500, with their element type; empty ones go."""
    x = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\n\s*\n")).alias("block_idx", "content"))
    x = x.withColumn("content", X.strip(F.replace("content", F.lit("─"), F.lit("")))).where("content <> ''")
    return x.withColumn("element_type", X.element_type(F.col("content")))


def block_style(spans: DataFrame) -> DataFrame:
    """S3: of a block's spans (page, block, idx, font, size, baseline, y, x0, x1) the mean size, first font and baseline, mean line gap."""
    from pyspark.sql import Window

    w = Window.partitionBy("page", "block").orderBy("idx")
    x = spans.withColumn("gap", F.col("y") - F.lag("y").over(w))
    return x.groupBy("page", "block").agg(F.avg("size").alias("font_size"), F.min_by("font", "idx").alias("font"), F.min_by("baseline", "idx").alias("baseline"), F.avg("gap").alias("line_height"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def alignment(x0: Column, x1: Column, page_width: float) -> Column:
    """S3: centre within 50 of the page's, right beyond 60 %, else left."""
    return F.when(F.abs((x0 + x1) / 2 - page_width / 2) < 50, "center").when(x0 > 0.6 * page_width, "right").otherwise("left")


def span_style(spans: DataFrame) -> DataFrame:
    """The last span of a block sets its size and weight; texts are joined in order and normalised."""
    g = spans.groupBy("page", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "").alias("raw_text"), F.max_by("size", "idx").alias("font_size"), F.max_by("is_bold", "idx").alias("is_bold"))
    return g.withColumn("text", X.normalize_marks(F.col("raw_text"))).where("text <> ''")


def image_rows(images: DataFrame) -> DataFrame:
    """The first rectangle of each image, 0, 0, 100, 100 where there is none."""
    g = images.groupBy("page", "xref").agg(F.min_by(F.struct("x", "y", "width", "height"), "idx").alias("r"))
    d = {"x": 0.0, "y": 0.0, "width": 100.0, "height": 100.0}
    return g.select("page", "xref", *[F.coalesce(F.col(f"r.{c}"), F.lit(v)).alias(c) for c, v in d.items()])


def worker_result(lines: DataFrame, marker: str = "MARKER_RESULT:") -> DataFrame:
    """The JSON after the marker of a subprocess's output lines (value)."""
    own = lines.where(F.col("value").startswith(marker))
    return own.select(F.from_json(F.substring(F.col("value"), len(marker) + 1, 1 << 30), "success boolean, text string, error string").alias("r")).select("r.*")


def first_success(*candidates: Column) -> Column:
    """The first answer that is not null or blank."""
    return F.coalesce(*[F.when(X.strip(c) != "", c) for c in candidates])


def route(has_formulas: Column, prefer: Column, ocr: Column, layout: Column, raw: Column) -> Column:
    """OCR text for formulas or on wish, else the layout text of over 100 characters, else OCR, else raw text."""
    return F.coalesce(F.when(has_formulas | prefer, first_success(ocr)), F.when(F.length(layout) > 100, layout), first_success(ocr), raw)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def cache_export(spark: SparkSession, path: str) -> DataFrame:
    """A cache's JSON export."""
    return spark.read.schema(CACHE).json(path)


def import_cache(cache: DataFrame, imported: DataFrame) -> DataFrame:
    """Rows whose key is not there yet; of repeats of a key the newest."""
    new = imported.groupBy("cache_key").agg(F.max_by(F.struct(*imported.columns), F.struct("created_at", "translated")).alias("r")).select("r.*")
    return cache.unionByName(new.join(cache.select("cache_key"), "cache_key", "left_anti").select(*cache.columns))


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Saved states; files that do not parse are left out."""
    x = spark.read.schema(CHECKPOINT + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").option("multiLine", "true").json(path)
    return x.where("_bad is null and job_id is not null").drop("_bad")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs still to do of a saved batch."""
    return spark.read.schema(JOBS).json(path).where(F.col("status").isin("pending", "running"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of time | level | module | message, with at least these four parts."""
    p = F.split("value", r" \| ")
    return spark.read.text(path).where(F.size(p) >= 4).select(X.strip(p[0]).alias("time"), X.strip(p[1]).alias("level"), X.strip(p[2]).alias("module"), F.array_join(F.slice(p, F.lit(4), F.size(p)), " | ").alias("message"))


def latest(spark: SparkSession, path: str) -> str | None:
    """The last file by name."""
    return spark.read.format("binaryFile").load(path).agg(F.max("path")).first()[0]


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, lang, translation, domain) rows of glossary files."""
    x = spark.read.schema(GLOSSARY).option("multiLine", "true").json(path)
    return x.select("domain", F.col("target_language").alias("lang"), F.explode("terms").alias("term", "translation"))


def ocr_text(tokens: DataFrame) -> DataFrame:
    """An image's words with confidence over 0, and their mean confidence as a share."""
    t = tokens.where("conf > 0")
    return t.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda s: s["word"]), " ").alias("text"), (F.avg("conf") / 100).alias("confidence"))
