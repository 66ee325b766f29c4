"""The contents lane: full-text search by BM25 over postings of the query batch's terms only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

from .names import BATCH, batch

K1, B = 1.2, 0.75


def tokenized(chunks: DataFrame, *columns: str) -> DataFrame:
    """chunks with `tokens`, the array of full-text terms of each column, and their number."""
    columns = columns or ("text",)
    terms = chunks.withColumn("tokens", F.array(*[X.search_terms(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    return terms.withColumn("n_tokens", sum((F.size(F.get("tokens", F.lit(k))) for k in range(1, len(columns))), F.size(F.get("tokens", F.lit(0)))))


def postings(docs: DataFrame, terms: DataFrame, weights: tuple[float, ...] = (1.0,)) -> DataFrame:
    """chunk_id, query_id, term, n_terms, tf, n_tokens of rows that hold a term: a word, a prefix of three characters up, or a phrase.

    Every token meets the batch's terms once, by its term's first word or by the first three characters of a prefix; only
    tokens that meet one leave the join, and are counted before the shuffle.
    """
    first = F.get("words", F.lit(0))
    asked = batch(terms.withColumn("probe", F.when(F.col("prefix"), F.concat(F.substring(first, 1, 3), F.lit("*"))).otherwise(first)))
    any_prefix = terms.where("prefix").limit(1).count() > 0  # of the batch
    out = None
    for k, weight in enumerate(weights):
        words = docs.select("chunk_id", "n_tokens", F.get("tokens", F.lit(k)).alias("own"))
        if any_prefix:
            placed = words.select("chunk_id", "n_tokens", "own", F.explode(F.expr("sequence(0, 2 * greatest(size(own), 1) - 1)")).alias("at"))
            placed = placed.select("chunk_id", "n_tokens", "own", F.expr("cast(at div 2 as int)").alias("pos"), F.expr("if(at % 2 = 0, get(own, cast(at div 2 as int)), concat(substring(get(own, cast(at div 2 as int)), 1, 3), '*'))").alias("probe"))
        else:
            placed = words.select("chunk_id", "n_tokens", "own", F.posexplode("own").alias("pos", "probe"))
        held = F.expr("case when prefix then startswith(get(own, pos), get(words, 0)) when size(words) = 1 then true else slice(own, pos + 1, size(words)) = words end")
        met = placed.join(asked, "probe").where(held).select("chunk_id", "n_tokens", "query_id", "term", "n_terms", F.lit(float(weight)).alias("w"))
        out = met if out is None else out.unionByName(met)
    return out.groupBy("chunk_id", "n_tokens", "query_id", "term", "n_terms").agg(F.sum("w").alias("tf")).where("tf > 0")


def bm25(docs: DataFrame, terms: DataFrame, weights: tuple[float, ...] = (1.0,), pairs: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """chunk_id, query_id, score (negative, lower is better) of rows that hold all terms, or with pairs any two.

    Row and term counts are over all rows; `allowed` (query_id, chunk_id) filters before any rank.
    A row with m of the pair terms matches m * (m - 1) / 2 pairs, and each pair adds both its terms.
    """
    stats = docs.agg(F.count("*").alias("rows"), F.avg("n_tokens").alias("mean"))
    found = postings(docs, terms, weights)
    per_term = found.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    # per_term has a row for each term of the batch, stats one row.
    small = F.broadcast if terms.count() <= BATCH else (lambda x: x)
    weighed = found.join(small(per_term), ["query_id", "term"]).join(F.broadcast(stats))
    idf = F.ln((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    if allowed is not None:
        weighed = weighed.join(allowed, ["query_id", "chunk_id"], "left_semi")
    summed = weighed.groupBy("query_id", "chunk_id").agg(F.sum(F.when(idf > 0, idf).otherwise(1e-6) * norm).alias("s"), F.count("*").alias("m"), F.first("n_terms").alias("n_terms"))
    if pairs:
        return summed.where("m >= 2").select("query_id", "chunk_id", (-(F.col("m") - 1) * F.col("s")).alias("score"))
    return summed.where("m = n_terms").select("query_id", "chunk_id", (-F.col("s")).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query with their rank_no; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9), "chunk_id")
    return scored.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= k)


def lane(docs: DataFrame, strict: DataFrame, pairs: DataFrame | None = None, limit: int = 30, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, rank_no, confidence: one result for each item, in order of its best passage.

    Rows with all terms come first; where they give fewer than `limit` items, rows with any two of the pair terms
    follow. Of each kind the best 4 * limit passages are looked at, so that items with very many passages can leave fewer than `limit`. Confidence falls with the score relative to the query's first hit of that kind.
    """
    hits = top(bm25(docs, strict, allowed=allowed), 4 * limit).withColumn("step", F.lit(0))
    if pairs is not None:
        hits = hits.unionByName(top(bm25(docs, pairs, pairs=True, allowed=allowed), 4 * limit).withColumn("step", F.lit(1)))
    hits = hits.join(docs.select("chunk_id", "item_id"), "chunk_id")
    per_query = Window.partitionBy("query_id")
    first = Window.partitionBy("query_id", "item_id").orderBy("step", "rank_no")
    one = hits.withColumn("best", F.min_by("score", F.struct("step", "rank_no")).over(per_query)).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    strict_items = F.count(F.when(F.col("step") == 0, 1)).over(per_query)
    one = one.withColumn("_strict", strict_items).where((F.col("step") == 0) | (F.col("_strict") < limit))
    order = Window.partitionBy("query_id").orderBy("step", "rank_no", "item_id")
    part = F.when(F.col("best") == 0, 0.0).otherwise(F.greatest(F.least(F.col("score") / F.col("best"), F.lit(1.0)), F.lit(0.0)))
    return one.select("query_id", "item_id", "chunk_id", F.row_number().over(order).alias("rank_no"), (0.4 + 0.5 * part).alias("confidence"), "step").where(F.col("rank_no") <= limit)
