"""Change hints as a stream: hints of one path are put together, and passes wait for a quiet gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUIET_MICROS, MOST_PATHS = 300_000, 4096
_SLICE_MICROS = 60_000_000


def relevant(hints: DataFrame) -> DataFrame:
    """hints: path, action, recursive, content, ts. Accesses go; a hint without a path asks for a full rescan."""
    return hints.where("action in ('create', 'modify', 'remove', 'rename', 'lost') or path is null").withColumn("rescan", F.col("path").isNull() | (F.col("action") == "lost"))


def coalesced(hints: DataFrame) -> DataFrame:
    """One row for each path with its flags or-ed."""
    return relevant(hints).where("not rescan").groupBy("path").agg(F.max("recursive").alias("recursive"), F.max("content").alias("content"), F.count("*").alias("hints"))


def _table_passes(timed: DataFrame) -> DataFrame:
    """start, end, hints, lost, paths of each pass. Times are cut into minutes, each ordered by itself; a row for each minute tells what it takes over from those before."""
    rows = timed.where("ts is not null").select(F.unix_micros("ts").alias("at"), "path", "rescan").withColumn("slice", F.floor(F.col("at") / _SLICE_MICROS))
    own, earlier = Window.partitionBy("slice").orderBy("at"), Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy("slice").agg(F.max("at").alias("latest")).select("slice", F.max("latest").over(earlier).alias("before"))  # a row for each minute with hints
    before = F.coalesce(F.lag("at").over(own), F.col("before"))
    flagged = rows.join(edges, "slice").withColumn("opens", F.when(before.isNull() | (F.col("at") - before >= QUIET_MICROS), F.col("at")))
    opened = flagged.withColumn("start", F.max("opens").over(own))
    carried = flagged.groupBy("slice").agg(F.max("opens").alias("newest")).select("slice", F.max("newest").over(earlier).alias("open"))
    placed = opened.join(carried, "slice").withColumn("start", F.coalesce("start", "open"))
    by_path = placed.groupBy("start", "path").agg(F.max("at").alias("latest"), F.count("*").alias("hints"), F.max("rescan").alias("lost"))
    summed = by_path.groupBy("start").agg(F.max("latest").alias("latest"), F.sum("hints").alias("hints"), F.max("lost").alias("lost"), F.count("path").alias("paths"))
    return summed.select(F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("latest") + QUIET_MICROS).alias("end"), "hints", "lost", "paths")


def passes(hints: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """A row for each pass: the window from its first hint until a quiet gap, and whether it has to rescan everything.

    A hint that comes QUIET_MICROS after the one before, or later, begins a pass; hints without a time are in none. On a table passes are
    over all hints and paths are counted exactly. On a stream they are kept by the first folder of the path (hints without a path by
    themselves), because sessions of a stream need a key, and paths are counted by sketches of bounded size. Beyond MOST_PATHS a pass rescans.
    """
    timed, keys = relevant(hints), []
    if hints.isStreaming:
        timed, keys = timed.withWatermark("ts", watermark).withColumn("root", F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit(""))), ["root"]
        # A session window takes in a hint at its very end, so it is shorter by the least time.
        window = F.session_window("ts", f"{QUIET_MICROS - 1} microseconds").alias("w")
        summed = timed.groupBy(window, *keys).agg(F.count("*").alias("hints"), F.max("rescan").alias("lost"), F.approx_count_distinct("path", 0.01).alias("paths"))
        summed = summed.select(*keys, F.col("w.start").alias("start"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("end"), "hints", "lost", "paths")
    else:
        summed = _table_passes(timed)
    return summed.select(*keys, "start", "end", "hints", "paths", (F.col("lost") | (F.col("paths") > MOST_PATHS)).alias("rescan"))
