"""The queries op1 to op10: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, remainder, ship, spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; where it is one small file, over all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    ship(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    ship(spark)
    docs = _documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    return language.predict(docs, language.fit(docs.select("doc_id", "lang", "text"), ~held_out), held_out)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    judged = quality_rules.judge(_documents(spark, sf_dir))
    return judged.drop("rejected_by")  # its value depends on measured times


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    ship(spark)
    docs, held_out, stage = _documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2, Stage(spark, "lm")
    model, counts = lm.fit(docs.where(~held_out), stage)
    return lm.score(docs, model, counts, held_out, stage)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    return decontamination.matches(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    ship(spark)
    return licenses.scan(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    ship(spark)
    docs, held_out = _documents(spark, sf_dir), remainder(F.col("doc_id"), 4) == 2
    tagged = toxicity.tag(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out), held_out)
    return tagged.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from . import packing

    ship(spark)
    return packing.pack(_documents(spark, sf_dir), path("byte_bpe_50k.json"), capacity=1024)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_classifier

    ship(spark)
    held_out = remainder(F.col("doc_id"), 4) == 2
    scored = quality_classifier.fit_and_score(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), "quality", ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
