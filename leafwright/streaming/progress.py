"""Structured Streaming forms of the progress and cache operators - an extension: the reference has batch state only.

Each takes and returns a DataFrame that may stream. Event time has a watermark, so late rows and old state are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rates(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A9 by tumbling windows of event time: pages and mean seconds of each kind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("pages"), F.sum("value").alias("seconds")).select(F.col("window.start").alias("start"), "event_type", "pages", "seconds")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Working sessions of each user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), "user_id", "events")


def first_of_key(requests: DataFrame, key: str = "cache_key", ttl: str = "30 days") -> DataFrame:
    """Requests whose key was not seen within ttl; the state of a key goes when it expires."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def upsert_sink(path: str, key: str = "cache_key"):
    """T1 for foreachBatch: merges a micro-batch into a Parquet cache in versions, so a repeated batch writes its version again."""
    from leafwright.operators.state import upsert

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v={epoch - 1}"
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(old)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        cache = spark.read.parquet(old) if there else batch.withColumn("access_count", F.lit(1).cast("long")).limit(0)
        upsert(cache, batch).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write
