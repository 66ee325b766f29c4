"""Counts over the catalogue and queues, retrieval metrics, percentiles and generation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(items: DataFrame, extensions: list[str], scope: Column) -> DataFrame:
    """total, read, skipped and failed files of some extensions in a scope."""
    state = lambda s: F.count(F.when(F.col("content_state") == s, 1))
    return items.where(F.lower("extension").isin(*extensions) & scope).agg(F.count("*").alias("total"), state("indexed").alias("read"), state("skipped").alias("skipped"), state("failed").alias("failed"))


def queue(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """done, failed and pending chunks of a generation; vectors: chunk_id, vector, error_code."""
    joined = chunks.select("chunk_id").join(vectors.select("chunk_id", "vector", "error_code"), "chunk_id", "left")
    counted = joined.agg(F.count("*").alias("chunks"), F.count("vector").alias("done"), F.count("error_code").alias("failed"))
    return counted.select("done", "failed", F.greatest(F.col("chunks") - F.col("done") - F.col("failed"), F.lit(0)).alias("pending"))


def retrieval(results: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """recall@1/3/k, MRR@k, NDCG@k and top-1 for each query.

    results: query_id, item_id, rank_no, repeats of an item count once; judgments: query_id, item_id,
    grade (2 relevant, 1 related). Gains are 3 and 1, discounts 1 / log2(rank + 1).
    """
    once = results.groupBy("query_id", "item_id").agg(F.min("rank_no").alias("rank_no"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank_no", "item_id"))
    graded = once.withColumn("place", place).where(F.col("place") <= k).join(judgments, ["query_id", "item_id"])
    gain = F.when(F.col("grade") == 2, 3.0).when(F.col("grade") == 1, 1.0).otherwise(0.0)
    hit = lambda n: F.count(F.when((F.col("grade") == 2) & (F.col("place") <= n), 1))
    found = graded.groupBy("query_id").agg(
        hit(1).alias("h1"), hit(3).alias("h3"), hit(k).alias("hk"), F.min(F.when(F.col("grade") == 2, F.col("place"))).alias("first"), F.sum(gain / F.log2(F.col("place") + 1)).alias("dcg")
    )
    best = judgments.where("grade in (1, 2)").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "item_id")))
    ideal = best.groupBy("query_id").agg(F.count(F.when(F.col("grade") == 2, 1)).alias("relevant"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1))).alias("idcg"))
    recall = lambda n, c: F.coalesce(F.col(c), F.lit(0)) / F.greatest(F.lit(1), F.least("relevant", F.lit(n)))
    return ideal.join(found, "query_id", "left").select(
        "query_id", recall(1, "h1").alias("recall_1"), recall(3, "h3").alias("recall_3"), recall(k, "hk").alias("recall_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"), F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("top_1"),
    )


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99, with count, mean and extremes, by group."""
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def generation(chunks: DataFrame, vectors: DataFrame, self_hits: Column) -> DataFrame:
    """Whether a generation may go live: nothing pending, at most 1 % failed, self-recall of 0.95 up."""
    counts = queue(chunks, vectors)
    total = F.col("done") + F.col("failed") + F.col("pending")
    ok = (F.col("pending") == 0) & (F.col("failed") * 100 <= total) & (self_hits >= 0.95)
    return counts.select("done", "failed", "pending", self_hits.alias("self_recall"), ok.alias("valid"))
