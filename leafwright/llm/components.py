"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of one file of a step's table, where there are more than one for each core.
EDGES_A_FILE = 100_000


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with, for each u, the least of its neighbours."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _state(edges: DataFrame) -> tuple:
    """Number of edges and two sums of hashes of all: equal if and, but for a chance of 2**-100, only if the edges are."""
    x = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(edges.agg(F.count("*"), *x).first())


def connected(edges: DataFrame, where: str, name: str = "cc", most: int = 60) -> DataFrame:
    """(id, component) for every id of an edge (a, b): component is the least id reachable.

    Each step reads and writes a table in the scratch folder; only a count and two sums reach the driver. Stars are joined
    on their centre by sort-merge joins that adaptive execution can split, so a component may hold any share of the rows.
    The tables have files by their number of edges, not by the session's partitions: a file costs two processes on local disks.
    Null ends and loops are left out; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    e = common.save(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), where, f"{name}-0"
    )
    state = _state(e)
    files = lambda: max(spark.sparkContext.defaultParallelism, -(-state[0] // EDGES_A_FILE))
    for i in range(1, most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        near = _least(large)
        small = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u > v").distinct()
        after = common.save(small.coalesce(files()), where, f"{name}-{i}")
        common.remove(spark, f"{where}/{name}-{i - 1}")
        e, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct()).coalesce(files())
