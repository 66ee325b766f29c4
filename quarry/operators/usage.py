"""Usage: decayed scores in log space, learned choices, suggestions, signals, retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_MS = 14 * 86_400_000
DECAY = math.log(2) / HALF_LIFE_MS


def rank_key(weight: Column, at: Column) -> Column:
    """One use in log space: comparable without a clock."""
    return F.ln(weight) + DECAY * at


def by_unit(uses: DataFrame) -> DataFrame:
    """Sums of uses (item_id, weight, at) by item and whole part in log space: a bounded number of rows for each item, combined before the shuffle."""
    keyed = uses.withColumn("k", rank_key(F.col("weight"), F.col("at"))).withColumn("unit", F.floor("k"))
    return keyed.groupBy("item_id", "unit").agg(F.sum(F.exp(F.col("k") - F.col("unit"))).alias("s"), F.count("*").alias("uses"), F.max("at").alias("last_used_at"))


def folded(sums: DataFrame) -> DataFrame:
    """item_id, uses, last_used_at, rank_key of the sums by unit, shifted by each item's largest unit."""
    top = sums.withColumn("top", F.max("unit").over(Window.partitionBy("item_id")))
    return top.groupBy("item_id").agg(F.sum("uses").alias("uses"), F.max("last_used_at").alias("last_used_at"), (F.first("top") + F.ln(F.sum(F.col("s") * F.exp(F.col("unit") - F.col("top"))))).alias("rank_key"))


def statistics(uses: DataFrame) -> DataFrame:
    """item_id, uses, last_used_at, rank_key of uses (item_id, weight, at)."""
    return folded(by_unit(uses))


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of old and new uses together: the sum is associative, so batches may be merged in any order."""
    both = stored.unionByName(new)
    top = F.max("rank_key").over(Window.partitionBy("item_id"))
    return both.withColumn("top", top).groupBy("item_id").agg(F.sum("uses").alias("uses"), F.max("last_used_at").alias("last_used_at"), (F.first("top") + F.ln(F.sum(F.exp(F.col("rank_key") - F.col("top"))))).alias("rank_key"))


def frecency(key: Column, now_ms: int) -> Column:
    """The decayed score at a time."""
    return F.exp(key - DECAY * now_ms)


def learned(uses: DataFrame, longest: int = 32) -> DataFrame:
    """query_key, item_id, uses, last_used_at: every beginning of a query key counts for the item opened with it."""
    opened = uses.where(F.col("use") == "primary").select("item_id", "at", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.length("query_key"), F.lit(longest))), lambda n: F.rtrim(F.substring(F.col("query_key"), F.lit(1), n))))).alias("query_key"))
    return opened.where("query_key != ''").groupBy("query_key", "item_id").agg(F.count("*").alias("uses"), F.max("at").alias("last_used_at"))


def choices(table: DataFrame, limit: int = 5) -> DataFrame:
    """The most chosen items of each key."""
    order = Window.partitionBy("query_key").orderBy(F.desc("uses"), F.desc("last_used_at"), "item_id")
    return table.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= limit)


def suggestions(stats: DataFrame, pins: DataFrame, limit: int = 20) -> DataFrame:
    """Pins, oldest first, then used items by score."""
    pinned = pins.select("item_id", F.lit(0).alias("tier"), F.col("pinned_at").cast("double").alias("sort"))
    used = stats.join(pins, "item_id", "left_anti").select("item_id", F.lit(1).alias("tier"), (-F.round("rank_key", 9)).alias("sort"))
    top = pinned.unionByName(used).orderBy("tier", "sort", "item_id").limit(limit)
    order = Window.orderBy("tier", "sort", "item_id")  # at most `limit` rows
    return top.withColumn("rank_no", F.row_number().over(order)).select("item_id", "tier", "rank_no", (1 - 0.01 * (F.col("rank_no") - 1)).alias("score"))


def signals(ids: DataFrame, stats: DataFrame, pins: DataFrame, table: DataFrame, now_ms: int) -> DataFrame:
    """ids: query_id, query_key, id. Adds pinned, frecency and query_uses."""
    s = stats.select(F.col("item_id").alias("id"), frecency(F.col("rank_key"), now_ms).alias("frecency"))
    p = pins.select(F.col("item_id").alias("id"), F.lit(True).alias("pinned"))
    c = table.select("query_key", F.col("item_id").alias("id"), F.col("uses").alias("query_uses"))
    return ids.join(s, "id", "left").join(p, "id", "left").join(c, ["query_key", "id"], "left").select("query_id", "id", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("frecency", F.lit(0.0)).alias("frecency"), F.coalesce("query_uses", F.lit(0)).alias("query_uses"))


def pruned(stats: DataFrame, cutoff_ms: int) -> DataFrame:
    return stats.where(F.col("last_used_at") >= cutoff_ms)


def pin(pins: DataFrame, new: DataFrame) -> DataFrame:
    """Pins with new ones; a pin that exists keeps its time."""
    return pins.unionByName(new).groupBy("item_id").agg(F.min("pinned_at").alias("pinned_at"))
