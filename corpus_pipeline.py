"""A corpus pipeline: quality classifier, quality rules, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and reads it again for the next stage. All stages but the last return the columns of
their docs. Rows that repeat a doc_id are one document to near-dedup: one of them stays. Decisions are made by
doc_id, so rows without one stay in every stage but the quality rules, which judge each row by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import decontamination, near_dedup, packing, quality_classifier, quality_rules
from quarry.llm.common import Stage, remainder, ship, table
from quarry.llm.decontamination import without

#: The score from which a document stays; the same as the classifier's query uses.
QUALITY = 0.7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    ship(spark)
    stage = Stage(spark, "classified")
    learn = remainder(F.col("doc_id"), 4) != 2
    scored = quality_classifier.fit_and_score(docs, table(spark, sf_dir, "labels"), "quality", learn)
    # Rejected ids are the smaller side; a document that repeats an id has one least score.
    rejected = stage.put(scored.groupBy("doc_id").agg(F.min("score").alias("score")).where(F.col("score") < QUALITY).select("doc_id"), "rejected")
    return without(docs, rejected)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects."""
    return quality_rules.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each near-duplicate component, and one row of it."""
    ship(spark)
    stage = Stage(spark, "deduplicated")
    found = stage.put(near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id"), "dropped")
    kept = without(docs, found)
    repeated = stage.put(kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    n = repeated.count()
    if not n:
        return kept
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    one = kept.join(repeated, "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return without(kept, repeated).unionByName(one.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, literally or with other values."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that stay into sequences."""
    from public_tokenizers import path

    ship(spark)
    return packing.pack(docs, path("byte_bpe_50k.json"), capacity=1024)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("packing", pack)]
#: The classifier and the token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = stage.put(step(spark, docs, sf_dir), f"{k}-{name}")
    return docs
