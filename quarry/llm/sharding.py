"""Contiguous shards of near-equal size, cut from global prefix sums of row sizes.

Rows are dealt to ranges of the document id and sorted there; each range gives one total. Prefix
sums over the totals (one row a range) turn running sums inside a range into global positions, and
equal targets cut them into shards. Only DataFrame operations are used. The text itself is read
once and never shuffled: its size and checksum travel.

Null texts have size 16 and the checksum of the empty text. Null ids come first. Equal rows are kept, in any
order among themselves. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its size, shard and gapless place in the shard.

    A row goes where its middle byte lies, so a shard misses its target by less than its two
    border rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "shards")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),  # deals even equal ids over ranges
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage.put(rows.repartitionByRange(width, "doc_id", "text_crc32", "tie").withColumn("range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select("range", F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range").orderBy("doc_id", "text_crc32", "tie")
    everything = totals.agg(F.sum("range_bytes").alias("all_bytes"))
    placed = (
        ranged.withColumn("n", F.row_number().over(inside).cast("long") - 1)
        .withColumn("bytes", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(starts), "range")  # one row a range: at most spark.sql.shuffle.partitions
        .join(F.broadcast(everything))  # one row
        .select(
            "doc_id", "size", "text_crc32",
            (F.col("rows_before") + F.col("n")).alias("position"),
            F.least(F.lit(shards - 1), F.expr(f"(2 * (bytes_before + bytes) + size) * {shards} div (2 * all_bytes)")).cast("int").alias("shard"),
        )
    )
    placed = stage.put(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))
