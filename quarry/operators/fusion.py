"""Fusion of ranked lanes by weighted reciprocal ranks, result rows and their contract."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAMPING = 60
WEIGHTS = {"names": 1.0, "contents": 1.0, "meaning": 2.0}
FIELDS = ("query_id", "lane", "item_id", "rank_no", "confidence", "match", "title", "subtitle", "passage")
ACTIONS = ("open", "open_with", "reveal", "copy_path", "copy_name", "run_as_admin", "pin")


def fuse(lanes: DataFrame, weights: dict[str, float] | None = None, limit: int = 30) -> DataFrame:
    """lanes: FIELDS, one row for each lane's hit. The best `limit` items of each query.

    Exact and intent matches come first, then the sum of weight / (60 + rank). The shown copy is the one that
    contributes most, by ties the earlier lane; a missing subtitle comes from the earliest copy that has one,
    a passage from the best copy that has one.
    """
    weights = {k: w if math.isfinite(w) else 0.0 for k, w in (WEIGHTS if weights is None else weights).items()}
    used = [k for k, w in weights.items() if w > 0]
    rows = lanes.where(F.col("lane").isin(used))
    place, weight = F.lit(len(used)), F.lit(0.0)
    for k, name in enumerate(used):
        place, weight = F.when(F.col("lane") == name, k).otherwise(place), F.when(F.col("lane") == name, weights[name]).otherwise(weight)
    rows = rows.withColumn("_lane", place).withColumn("_part", weight / (DAMPING + F.col("rank_no")))
    better = F.struct(F.round("_part", 12).alias("p"), (-F.col("_lane")).alias("l"), (-F.col("rank_no")).alias("r"))
    earlier = F.struct("_lane", "rank_no")
    best = rows.groupBy("query_id", "item_id").agg(
        F.sum("_part").alias("score"), F.max(F.col("match").isin("exact", "intent")).alias("intent"), F.max("confidence").alias("confidence"),
        F.max_by(F.struct("lane", "match", "title", "_lane", "rank_no"), better).alias("shown"), F.count("*").alias("lanes"),
        F.min_by("subtitle", F.when(F.col("subtitle").isNotNull(), earlier)).alias("subtitle"), F.max_by("passage", F.when(F.col("passage").isNotNull(), better)).alias("passage"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("intent"), F.desc(F.round("score", 12)), "shown._lane", "shown.rank_no", "item_id")
    ranked = best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return ranked.select("query_id", "position", "item_id", "score", "intent", "confidence", "shown.lane", "shown.match", "shown.title", "subtitle", "passage", "lanes")


def violations(results: DataFrame) -> DataFrame:
    """query_id, item_id, problem of result rows (title, confidence, actions, primary) that break the contract."""
    checks = {
        "empty title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "confidence": F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1),
        "unknown action": F.exists("actions", lambda a: ~a.isin(*ACTIONS)),
        "repeated action": F.size("actions") != F.size(F.array_distinct("actions")),
        "primary not offered": ~F.array_contains("actions", F.col("primary")),
        "unsafe primary": F.col("primary") == "run_as_admin",
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    own = results.select("query_id", "item_id", F.explode(found).alias("problem"))
    twice = results.groupBy("query_id", "item_id").count().where("count > 1").select("query_id", "item_id", F.lit("repeated result").alias("problem"))
    return own.unionByName(twice)
