"""Readies a session: the package goes to the executors, so that functions of a query find it on any machine, in small batches."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Arrow batches go to Python workers in about this many bytes, where the session has no value of its own.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Send the package to the executors and bound Arrow batches by bytes, unless the session says how.

    The bound is the one setting of the session that is made; it has no effect on any result.
    """
    ship(spark)
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB", None)
    if spark.conf.get(key, None) in usual:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def ship(spark: SparkSession) -> None:
    """Add a zip of the package's sources to the session's application, once; Spark serves it to every executor."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="leafwright-"), "leafwright.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("leafwright", os.path.relpath(path, top)))
    context.addPyFile(name)
    _sent.add(context.applicationId)
