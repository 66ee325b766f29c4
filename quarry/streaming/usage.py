"""Usage as a stream: each micro-batch's statistics merge into the stored table. Late events add their own decayed weight, so no watermark is needed for right results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quarry.operators import usage


def running(uses: DataFrame) -> DataFrame:
    """A streaming aggregate of uses (item_id, weight, at), which a reader folds with `usage.folded`."""
    return usage.by_unit(uses)


def write_statistics(uses: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch writes its own statistics under its batch id, so a batch that is run again replaces its rows; readers merge."""

    def save(batch: DataFrame, batch_id: int) -> None:
        usage.statistics(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return uses.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def read_statistics(spark, path: str) -> DataFrame:
    return usage.merge(spark.read.parquet(path).drop("batch"), spark.createDataFrame([], "item_id long, uses long, last_used_at long, rank_key double"))
