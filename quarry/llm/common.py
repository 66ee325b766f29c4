"""Helpers shared by the training-data operators: tables, shared intermediate storage, held-out rows."""

from __future__ import annotations

import ctypes
import functools
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Rows and bytes of a batch that goes to a Python worker: with very long texts the default of 10,000 rows would take GBs.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python workers: batches of bounded size, and this package where neither PYTHONPATH nor the working folder offers it."""
    for key, most in BATCHES.items():
        if spark.conf.get(key, None) is None:  # a session's own choice stays
            spark.conf.set(key, str(most))
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    known = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}
    if root in known or getattr(sc, "_quarry_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in (root / "quarry").rglob("*.py"):
            z.write(p, p.relative_to(root))
    # Executors fetch the file when they start, the late ones too, so it stays in the shared folder until the application ends.
    path = f"{shared_dir(spark)}/quarry_{uuid.uuid4().hex}.zip"
    fs, file = file_system(spark, path)
    out = fs.create(file)
    out.write(bytearray(packed.getvalue()))
    out.close()
    fs.deleteOnExit(file)
    sc.addPyFile(path)
    sc._quarry_shipped = True


def release() -> None:
    """Give freed memory back to the system, where its allocator keeps it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def lean(run):
    """A generator function for Python workers that releases memory before and after: one worker serves the tasks of all stages, and what an earlier one freed would stay with it."""

    @functools.wraps(run)
    def wrapped(*args):
        release()
        try:
            yield from run(*args)
        finally:
            release()

    return wrapped


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows dealt over all cores where its files give fewer splits than there are; larger tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one; a cluster has none to guess."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return sc.getCheckpointDir().rstrip("/")


class Stage:
    """Tables written to the shared folder: they cut lineage, survive lost executors and are read column-wise.

    They are removed with `drop`, at the latest when the application ends: write results that have to outlive it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        if not self.paths:
            fs, base = file_system(self.spark, self.base)
            fs.deleteOnExit(base)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            fs, path = file_system(self.spark, self.paths[name])
            fs.delete(path, True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def base_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that extra columns cannot clash with its own."""
    return docs.select(*[docs[n] for n in names])


def near_least(rows: DataFrame, own: str, by: str, most: Column | int) -> DataFrame:
    """The rows with the least hashes `own` of each value of `by`, a few more than `most`, decided row by row without a sort; adds `total`, the rows of that value."""
    most = F.lit(most) if isinstance(most, int) else most
    counted = rows.groupBy(by).agg(F.count("*").alias("total"))  # a row for each label
    share = F.least(F.lit(1.0), (most + 6 * F.sqrt(most) + 50) / F.col("total"))
    near = rows.join(F.broadcast(counted.withColumn("_cut", share * (1 << 30))), by)
    return near.where(F.pmod(F.col(own), F.lit(1 << 30)) <= F.col("_cut")).drop("_cut")


def least_hashed(rows: pa.Table, by: str, most: dict, budget: int) -> pa.Table:
    """Of rows (own, n and `by`) those of least hash: at most so many of each value; rows whose n bytes don't fit into what is left of its share of the budget are passed over, but for the first of a value."""
    own, n = np.asarray(rows.column("own")) % (1 << 30), np.asarray(rows.column("n"))
    values = np.asarray(rows.column(by).to_pylist(), dtype=object)
    kept: list[int] = []
    for value in most:
        left, count = budget * most[value] / sum(most.values()), 0
        mine = np.flatnonzero(values == value)
        for k in mine[np.lexsort((np.asarray(rows.column("own"))[mine], own[mine]))]:
            if count < most[value] and n[k] <= (left if count else budget):
                kept.append(int(k))
                left, count = left - n[k], count + 1
    return rows.take(pa.array(sorted(kept), pa.int64()))
