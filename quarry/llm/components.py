"""Connected components by alternating large-star and small-star steps on a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """edges: a, b (long). Returns id, component (the least id reachable) for every id in an edge.

    Each step replaces a node's edges by edges to its least neighbour, so that all trees become
    stars; no neighbour list is gathered, a node with many edges only has a minimum taken. Ends
    when a step changes nothing.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = stage.put(edges, f"{name}-0")
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    seen, k = state(), 0
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b")  # every larger neighbour to the least
        large = large.where("a < b").distinct()
        # small star: of each node, the smaller neighbours and itself to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("low").alias("x"), F.col("b").alias("y")))
        k += 1
        new = stage.put(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{name}-{k}")
        stage.drop(f"{name}-{k - 1}")
        edges = new
        now = state()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
