"""The search model's tables, derived from plain tables with fixed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X

HOUR_MS = 3_600_000
BASE_MS = 1_700_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows dealt over all cores where its files give fewer splits than there are; larger tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def extension(doc_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("txt", "md", "py", "csv", "pdf")]), (doc_id % 5 + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of kind file: one for each document."""
    d = read(spark, sf_dir, "documents")
    d = d.select(F.col("doc_id").alias("id"), "source", "lang", extension(F.col("doc_id")).alias("extension"), F.col("n_chars").alias("size"))
    d = d.withColumn("name", F.format_string("doc_%d.%s", "id", "extension"))
    return d.select(
        "id", F.lit("file").alias("kind"), "name", F.concat_ws("/", F.lit(""), "source", "lang", "name").alias("path"), "extension", "size",
        (F.lit(BASE_MS) + F.col("id") * HOUR_MS).alias("modified"), F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("attributes"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the names lane: one for each part, in folders by brand and type."""
    p = read(spark, sf_dir, "part")
    path = F.concat_ws("/", F.lit(""), F.regexp_replace("p_brand", "#", "-"), F.lower("p_type"), "p_name")
    return p.select(
        F.col("p_partkey").alias("id"), F.lit("files").alias("source"), F.col("p_name").alias("name"), X.fold_key(F.col("p_name")).alias("name_key"), path.alias("path"),
        (F.lit(BASE_MS) + F.col("p_size").cast("long") * 24 * HOUR_MS).alias("modified"), F.when(F.col("p_partkey") % 11 == 0, 1).otherwise(0).alias("attributes"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each line with text of a document."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    d = d.select(F.col("doc_id").alias("item_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return d.where(F.trim("text") != "").select((F.col("item_id") * 100_000 + F.col("ordinal")).alias("chunk_id"), "item_id", "ordinal", "text")


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events with weights: purchases open an item, clicks reveal it, views copy it."""
    kinds = {"purchase": ("primary", 1.0), "click": ("reveal", 0.5), "view": ("copy", 0.3)}
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds))
    kind, weight = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for name, (k, w) in kinds.items():
        kind, weight = kind.when(F.col("event_type") == name, k), weight.when(F.col("event_type") == name, w)
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").alias("item_id"), kind.alias("use"), weight.alias("weight"), at.alias("at"), F.concat(F.lit("q "), "event_type", F.lit(" "), (F.col("event_id") % 5).cast("string")).alias("query_key"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
