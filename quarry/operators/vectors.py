"""Vectors: normalisation, exact top-k by blocked matrix products, validity by sequence numbers, generations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors up to which a batch goes to every worker at once; a larger one is searched in blocks of this size.
QUERY_BLOCK = 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column, dims: int | None = None) -> Column:
    """The first dims at unit length; null for a non-finite or zero vector."""
    v = F.slice(v, 1, dims) if dims else v
    norm = F.sqrt(dot(v, v))
    return F.when((norm >= 1e-12) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """query_id, chunk_id, similarity, rank_no: the exact best k for each query, ties by id.

    vectors: chunk_id, vector. queries: query_id, vector. Every partition multiplies its rows with a
    block of queries and keeps k each, so only partitions * queries * k rows are shuffled.
    """
    out = None
    rows = queries.select("query_id", "vector").orderBy("query_id").toLocalIterator()
    block: list = []

    def searched(block: list) -> DataFrame:
        ids, q = np.array([r.query_id for r in block]), np.array([r.vector for r in block], dtype=np.float64)

        def run(frames):
            for f in frames:
                if not len(f):
                    continue
                s = q @ np.stack(f.vector.to_numpy()).astype(np.float64).T
                keys = f.chunk_id.to_numpy()
                for i in range(len(ids)):
                    order = np.lexsort((keys, -np.round(s[i], 9)))[:k]
                    yield pd.DataFrame({"query_id": ids[i], "chunk_id": keys[order], "similarity": s[i][order]})

        return vectors.select("chunk_id", "vector").mapInPandas(run, "query_id long, chunk_id long, similarity double")

    for r in rows:
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out, block = (searched(block) if out is None else out.unionByName(searched(block))), []
    if block or out is None:
        found = searched(block) if block else vectors.sparkSession.createDataFrame([], "query_id long, chunk_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if floor is not None:
        out = out.where(F.col("similarity") >= floor)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "chunk_id")
    return out.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k)


def current(snapshot: DataFrame, delta: DataFrame, built_through: int) -> DataFrame:
    """The valid rows of a snapshot and the writes after it: a snapshot row is valid unless written again or removed later.

    Both: chunk_id, seq, vector; in delta a null vector removes.
    """
    order = Window.partitionBy("chunk_id").orderBy(F.desc("seq"))
    both = snapshot.where(F.col("seq") <= built_through).unionByName(delta.where(F.col("seq") > built_through))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1 and vector is not null").drop("_n")


def write_sequence(rows: DataFrame, after: int, *order: str) -> DataFrame:
    """Numbers new writes after the last one: offsets of id ranges are summed over per-range totals, not in one task."""
    ranged = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    totals = ranged.groupBy("_p").agg(F.max("_n").alias("_total"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select("_p", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(starts), "_p").withColumn("seq", F.lit(after) + F.col("_before") + F.col("_n")).drop("_p", "_n", "_before")


def rebuild_due(stored: Column, built: Column, delta: Column, stale: Column, has_file: Column, incomplete: Column) -> Column:
    """Whether an index snapshot is due: none and 2,000 rows, a delta of 2,000 and a tenth, or a fifth stale."""
    return F.when(~has_file | incomplete, stored >= 2000).otherwise(((delta >= 2000) & (delta * 10 >= built)) | (stale * 5 >= F.greatest(built, F.lit(1))))


def centroids(vectors: DataFrame, cells: int, rounds: int = 8, sample_rows: int = 20_000, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a bounded sample: the rows of least hash."""
    rows = vectors.select("vector", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(sample_rows).toPandas()
    x = np.stack(rows.vector.to_numpy()).astype(np.float64)
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def ivf_index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row with the cell of its nearest centre; written partitioned by cell, a search reads few cells."""

    def run(frames):
        for f in frames:
            f["cell"] = (np.stack(f.vector.to_numpy()).astype(np.float64) @ centres.T).argmax(1) if len(f) else []
            yield f[["chunk_id", "vector", "cell"]].astype({"cell": "int32"})

    return vectors.select("chunk_id", "vector").mapInPandas(run, "chunk_id long, vector array<float>, cell int")


def ivf_search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """The best k among each query's `probes` nearest cells."""

    def run(frames):
        for f in frames:
            for q, v in zip(f.query_id, f.vector):
                near = np.argsort(-(centres @ np.asarray(v, dtype=np.float64)), kind="stable")[:probes]
                yield pd.DataFrame({"query_id": q, "cell": near.astype("int32"), "q": [v] * len(near)})

    asked = queries.select("query_id", "vector").mapInPandas(run, "query_id long, cell int, q array<float>")
    scored = index.join(asked, "cell").select("query_id", "chunk_id", dot(F.col("q"), F.col("vector")).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "chunk_id")
    return scored.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k)


@F.pandas_udf(T.BinaryType())
def pack_f16(v: pd.Series) -> pd.Series:
    """Little-endian half floats, rounded to even."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").astype("<f2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_f16(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f2").astype("<f4"))
