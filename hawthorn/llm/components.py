"""Connected components by alternating large-star and small-star rounds, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, release, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked with the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "n")
    up = both.filter("v > u").join(least, F.col("u") == F.col("n"))
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked with the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    down = edges.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("n").alias("u"), F.col("m").alias("v"))
    return down.union(own).filter("u <> v").distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """node, component (the least node reachable) for the nodes of edges (u, v); stored.

    Each round writes its edges to the shared folder; a hot node's edges meet its least
    neighbour in a join that AQE can split. Ends when a round changes nothing (stars only).
    """
    e = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), label)
    mark = None
    while True:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
        after = store(_small_star(_large_star(e)), label)
        forget(e)
        e = after
        release(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
