"""What the operators share: scratch tables, Arrow batches, folds and range splits."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ready as ready

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "")
#: Texts of one Arrow batch are handled in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
#: Tasks of one range split at most; beyond, tasks stream more rows each.
MOST_TASKS = 200_000
#: The manifest of so many ranges of files is one file of a table.
RANGES_A_MANIFEST = 64


_held: dict[str, Callable[[], None]] = {}


def hold(name: str = "", drop: Callable[[], None] | None = None) -> None:
    """Called where an operator's task begins in a worker: what other operators hold there (caches, encoders) goes."""
    others = [k for k in _held if k not in (name, "")]
    for k in others:
        _held.pop(k)()
    if others:
        trim()
    _held[name] = drop or (lambda: None)


def trim() -> None:
    """Give freed memory of this process back to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir, or below the warehouse where that is unset.

    Both are folders that all machines share. What is left in it goes when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    where = f"{base.rstrip('/')}/leafwright/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(where)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at)
    system.deleteOnExit(at)
    return where


def save(df: DataFrame, where: str, name: str) -> DataFrame:
    """Write a table below where and read it again: cuts lineage and survives lost executors.

    No _SUCCESS file: nothing reads it, and where Hadoop has no native library the driver would fork twice to set its rights.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{where}/{name}")
    return spark.read.schema(df.schema).parquet(f"{where}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, where: str = "", *names: str) -> None:
    """Delete scratch tables that are read no more, and let Spark drop the shuffle files of frames that are out of use: it does
    so when the driver collects its garbage, which may otherwise be long after they have filled the disks.

    Executors collect theirs too, as a JVM gives back heap that it has once taken only then. While one starts a process (twice
    for each file of a table, where Hadoop has no native library) all it has taken counts a second time.
    """
    for name in names:
        remove(spark, f"{where}/{name}")
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("x")).agg(F.count("x")).collect()


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """The path of a public vocabulary file: in folder, in $TOKENIZER_DIR or as the public_tokenizers package has it."""
    if folder or TOKENIZERS:
        return os.path.join(folder or TOKENIZERS, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def held_out(col: str = "doc_id"):
    """True for the fifth of ids with crc32(id as text) mod 5 = 0, which no model learns from."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], limit: int) -> DataFrame:
    """At most limit labelled rows outside the held-out fold, with their whole texts, in the order of a hash of the id.

    The bound keeps the broadcast side and what the driver gets small at every input size. Rows of either table without
    an id, and labels that are all null, are left out; of repeated ids one row is taken.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(*[F.max(c).alias(c) for c in label_cols])
        .where(F.coalesce(*[F.col(c) for c in label_cols]).isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", *label_cols).agg(F.min("text").alias("text"))


def in_one_task(sample: DataFrame, *keys: str) -> DataFrame:
    """A bounded sample as one partition sorted by keys, for a model to be fitted on an executor instead of the driver."""
    return sample.repartition(1).sortWithinPartitions(*keys)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about most bytes of text each; a longer text is a slice of its own."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at)
    if not len(texts):
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype("int64")
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def ranges(df: DataFrame, rows_each: int) -> int:
    """How many ranges of about rows_each rows df has."""
    return int(min(MOST_TASKS, max(1, -(-df.count() // rows_each))))


def ranged(df: DataFrame, keys: list, rows_each: int, order: list | None = None, parts: int = 0) -> DataFrame:
    """df range-shuffled by keys into about rows_each rows a partition (or parts) and sorted in each by order (keys, if not given).

    The partition's number (TaskContext) is then its place among the ranges. Keys that go on with a hash of the row split an
    id that many rows have.
    """
    return df.repartitionByRange(parts or ranges(df, rows_each), *keys).sortWithinPartitions(*(order or keys))


def save_manifest(written: DataFrame, parts: int, where: str) -> DataFrame:
    """Save what the tasks of parts ranges say of the files that they wrote, in few tables' files instead of one a task.

    Spark's local file system forks the executor's JVM twice for each file of a table to set its rights.
    """
    return save(written.repartition(-(-parts // RANGES_A_MANIFEST)), where, "manifest")


def readers(manifest: DataFrame, size: str, each: int) -> int:
    """Tasks to read a manifest's files back: about each of column size a task, but no cores idle; a file each at most."""
    files, total = manifest.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return max(1, min(files, MOST_TASKS, max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total // each))))
