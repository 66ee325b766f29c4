"""The names lane: candidates by equi-joins on two-character blocks, scored by tiers, with priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

DAY_MS = 86_400_000
#: Queries up to which a batch is broadcast; a larger one is shuffled.
BATCH = 20_000


def batch(queries: DataFrame) -> DataFrame:
    return F.broadcast(queries) if queries.count() <= BATCH else queries


def indexed(items: DataFrame) -> DataFrame:
    """items: id, name, name_key, path, ... Adds stem, name_tokens and folder_tokens."""
    return items.withColumns({"stem": X.stem(F.col("name_key")), "name_tokens": X.name_parts(F.col("name")), "folder_tokens": X.path_tokens(F.col("path"))})


def _blocks(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: F.substring(v, 1, 2)))


def candidates(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of query and item that share the beginning of the name or of a token.

    Every tier needs such a beginning: a name begins with the key, a token with a query token, and a
    typo is looked for among names and tokens with the key's first two characters.
    """
    item_blocks = items.select("id", F.explode(_blocks(F.concat(F.array("name_key"), "name_tokens", F.transform("name_tokens", lambda t: F.substring(t, 1, 1)), F.array(F.substring("name_key", 1, 1))))).alias("block"))
    query_blocks = queries.select("query_id", F.explode(_blocks(F.concat(F.array("key"), "tokens"))).alias("block"))
    pairs = item_blocks.join(batch(query_blocks), "block").select("query_id", "id").distinct()
    return pairs.join(items, "id").join(batch(queries), "query_id")


def _greedy(tokens: Column, names: Column) -> Column:
    """For query tokens, longest first, the place of the first unused name token each begins; null where one has none."""
    n = F.size(names)
    order = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.octet_length(t)).alias("k"), i.alias("i"), t.alias("t"))))
    start = F.struct(F.array().cast("array<struct<i:int,at:int>>").alias("used"), F.lit(True).alias("ok"))

    def take(acc, q):
        free = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.get(names, j).startswith(q.t) & ~F.exists(acc.used, lambda u: u.at == j))
        hit = F.get(free, F.lit(0))
        return F.struct(F.when(hit.isNull(), acc.used).otherwise(F.concat(acc.used, F.array(F.struct(q.i.alias("i"), hit.alias("at"))))).alias("used"), (acc.ok & hit.isNotNull()).alias("ok"))

    return F.aggregate(order, start, take, lambda acc: F.when(acc.ok, F.transform(F.array_sort(acc.used), lambda u: u.at)))


def base_scores(pairs: DataFrame) -> DataFrame:
    """Adds base and match (exact, prefix, fuzzy); pairs without a match go. The first tier that holds decides."""
    key, stem, chars = F.col("key"), F.col("stem"), F.length("key")
    begins = lambda t, names: F.exists(names, lambda n: n.startswith(t))
    in_name = F.size(F.filter("tokens", lambda t: begins(t, F.col("name_tokens"))))
    anywhere = F.forall("tokens", lambda t: begins(t, F.concat("name_tokens", "folder_tokens")))
    taken = pairs.withColumn("taken", _greedy(F.col("tokens"), F.col("name_tokens")))
    at = F.col("taken")
    in_order = (F.get(at, F.lit(0)) == 0) & F.forall(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i) > F.get(at, i - 1)))
    cover = X.ratio(F.aggregate("tokens", F.lit(0), lambda n, t: n + F.length(t)), F.length(stem))
    tier = (
        F.when(F.col("name_key") == key, F.struct(F.lit(1.0).alias("base"), F.lit("exact").alias("match")))
        .when(stem == key, F.struct(F.lit(0.97).alias("base"), F.lit("exact").alias("match")))
        .when(F.col("name_key").startswith(key), F.struct((0.80 + 0.12 * X.ratio(chars, F.length(stem))).alias("base"), F.lit("prefix").alias("match")))
        .when(at.isNotNull(), F.struct((F.when(in_order, 0.78).otherwise(0.70) + 0.08 * cover).alias("base"), F.lit("prefix").alias("match")))
        .when((F.size("tokens") > 1) & anywhere & (in_name > 0), F.struct((0.5 + 0.1 * in_name / F.size("tokens")).alias("base"), F.lit("prefix").alias("match")))
    )
    tiered = taken.withColumn("tier", tier).drop("taken")
    matched = tiered.where("tier is not null").select("*", "tier.*").drop("tier")
    # Only pairs without any other match, and close enough by a looser distance, go to Python.
    budget = X.typo_budget(chars)
    options = F.filter(F.concat(F.array("stem"), "name_tokens"), lambda c: (F.levenshtein(c, key) <= 2 * budget) | (F.levenshtein(F.left(c, chars + 1), key) <= 2 * budget))
    typed = tiered.where("tier is null").drop("tier").withColumn("_options", options).withColumn("_budget", budget).where((F.col("_budget") > 0) & (F.size("_options") > 0))
    typed = typed.withColumn("_d", X.typo_distance(F.col("key"), F.col("_options"), F.col("_budget"))).where("_d is not null")
    fuzzy = typed.withColumn("base", 0.45 - 0.08 * F.col("_d")).withColumn("match", F.lit("fuzzy")).drop("_d", "_options", "_budget")
    return matched.unionByName(fuzzy)


def phrases_match(phrases: Column, names: Column) -> Column:
    """Every phrase's tokens stand side by side in the name."""
    return F.forall(phrases, lambda p: (F.size(p) > 0) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))), lambda i: F.slice(names, i, F.size(p)) == p))


def prior(now_ms: int, source: Column, modified: Column, attributes: Column, path: Column) -> Column:
    """Applications and recent items rise; hidden, system and deep ones sink."""
    age = F.lit(now_ms) - modified
    recent = F.when(age < 3 * DAY_MS, 0.04).when(age < 30 * DAY_MS, 0.02).otherwise(0.0)
    depth = F.length(path) - F.length(F.translate(path, "/\\", ""))
    deep = F.least(F.greatest(depth - 4, F.lit(0)) * 0.004, F.lit(0.04))
    return F.when(source == "apps", 0.06).otherwise(0.0) + recent - F.when(attributes.bitwiseAND(3) != 0, 0.15).otherwise(0.0) - deep


def usage_prior(pinned: Column, frecency: Column, query_uses: Column) -> Column:
    """Pins, decayed use and picks for this very query, each bounded."""
    used = F.when(frecency > 0, F.least(0.025 * F.log1p(frecency), F.lit(0.08))).otherwise(0.0)
    picked = F.when(query_uses > 0, F.least(0.12 + 0.08 * F.ln(query_uses), F.lit(0.35))).otherwise(0.0)
    return F.when(pinned, 0.05).otherwise(0.0) + used + picked


def search(items: DataFrame, queries: DataFrame, now_ms: int, limit: int = 30, signals: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """query_id, id, rank_no, base, score, match: the best `limit` names of each query.

    signals: query_id, id, pinned, frecency, query_uses; applied to the first limit * 5 by score, and to learned items.
    learned: query_id, id of items chosen for a query before; those that its text doesn't find have base 0.6. Queries with phrases have none.
    """
    known = indexed(items)
    scored = base_scores(candidates(known, queries)).where(phrases_match(F.col("phrases"), F.col("name_tokens")) | (F.size("phrases") == 0))
    if learned is not None:
        learned = learned.select("query_id", "id").distinct().join(batch(queries.where(F.size("phrases") == 0).select("query_id")), "query_id", "left_semi")
        chosen = learned.join(batch(queries), "query_id").join(known, "id")
        unmatched = chosen.join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti")
        scored = scored.unionByName(unmatched.withColumns({"base": F.lit(0.6), "match": F.lit("suggestion")}))
        scored = scored.join(learned.withColumn("_learned", F.lit(True)), ["query_id", "id"], "left")
    scored = scored.withColumn("score", F.col("base") + prior(now_ms, F.col("source"), F.col("modified"), F.col("attributes"), F.col("path")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.length("name"), "id")
    if signals is not None:
        kept = (F.col("_n") <= 5 * limit) | F.col("_learned").isNotNull() if learned is not None else F.col("_n") <= 5 * limit
        head = scored.withColumn("_n", F.row_number().over(order)).where(kept).drop("_n")
        scored = head.join(signals, ["query_id", "id"], "left").withColumn("score", F.col("score") + usage_prior(F.coalesce("pinned", F.lit(False)), F.coalesce("frecency", F.lit(0.0)), F.coalesce("query_uses", F.lit(0))))
    return scored.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= limit).select("query_id", "id", "rank_no", "base", "score", "match", "name", "path")
