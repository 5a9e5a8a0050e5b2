"""Connected components of an edge table by alternating large-star and small-star steps; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour v > u is linked to the least of u's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and u itself, is linked to u's least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (u, v: long, u != v) but the least of each component.

    component is the least id reachable.  Steps repeat until the edges are stars round the least vertices; each
    result is a table in the shared folder, so an executor's loss costs one step.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now, seen = stored(edges, "edges"), None
    while True:
        large = stored(_large_star(now), "large_star")
        after = stored(_small_star(large), "small_star")
        discard(now)
        discard(large)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = state
