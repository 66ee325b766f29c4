"""Registered queries of the search-analytics engine, each over whole tables. Names give the operator; docs give what it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.embedding import embed
from quarry.operators import chunking, contents, fusion, inventory, metrics, names, states, usage, vectors
from quarry.plans import query as Q
from quarry.sources import model as M
from quarry.streaming import changes
from quarry.streaming import usage as stream_usage

NOW_MS = M.BASE_MS + 40 * Q.DAY_MS
NAME_QUERIES = {"n1": "red bolt", "n2": "blue", "n3": "gea", "n4": "gizmo cold", "n5": "hot rd", "n6": "smal ring", "n7": "brand small widget"}
TERM_QUERIES = {"c1": "the of", "c2": "tion and", "c3": "que de la", "c4": "der die", "c5": "with that this thing"}
PAIR_QUERIES = {"p1": "thing stea tion eran", "p2": "queue ciones boar", "p3": "eder ching"}
PREFIX_QUERIES = {"x1": "the thi", "x2": "ing", "x3": "and ere"}
PHRASE_QUERIES = {"f1": '"of the"', "f2": '"in the" and', "f3": '"license version"'}
EVENT_NOW = 1_706_745_600_000


def _round(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# --- text functions -----------------------------------------------------------------------------


def text_name_tokens(spark, d):
    """Code-aware tokens and stems of names."""
    urls = M.read(spark, d, "pages").select("page_id", "url")
    return urls.select("page_id", F.array_join(X.code_tokens(F.col("url")), " ").alias("tokens"), X.stem(F.col("url")).alias("stem"))


def text_path_parts(spark, d):
    """Tokens of the last three folders."""
    return M.names(spark, d).select("id", F.array_join(X.path_tokens(F.col("path")), " ").alias("path_parts"))


def text_fold(spark, d):
    """X1 on Latin letters: search keys."""
    return M.read(spark, d, "conversations").select("conv_id", "turn", X.fold_key(F.col("text")).alias("key"))


def text_token_estimate(spark, d):
    """Model tokens without a tokenizer."""
    return M.spread(M.read(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def text_snippets(spark, d):
    """One-line excerpts after newline normalisation."""
    return M.read(spark, d, "conversations").select("conv_id", "turn", X.one_line(X.newlines(F.col("text"))).alias("snippet"))


def text_fingerprints(spark, d):
    """Fingerprints, prompts and digests."""
    f = M.files(spark, d)
    return f.select("id", X.fingerprint(F.col("size"), F.col("modified")).alias("fingerprint"), X.document_prompt(F.when(F.col("id") % 3 == 0, F.lit(" ")).otherwise(F.col("name")), F.col("path")).alias("prompt"), F.sha2("path", 256).alias("digest"))


def document_kinds(spark, d):
    """Kinds by extension, counted."""
    return M.files(spark, d).groupBy(F.coalesce(chunking.kind_of(F.col("extension")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


# --- filters ------------------------------------------------------------------------------------


def _filtered(spark, d, text: str) -> DataFrame:
    f = M.files(spark, d)
    return f.where(Q.condition(Q.parse(text).filters, F.col("kind"), F.col("extension"), F.col("path"), F.col("modified")))


def filter_metadata(spark, d):
    """Parsed filters over the inventory."""
    return _filtered(spark, d, "type:document ext:csv after:2023-11-15 before:2024-01-01").select("id", "path", "modified")


def filter_folder(spark, d):
    """an absolute folder and below."""
    return _filtered(spark, d, "in:/src1/en type:document").select("id", "path")


def filter_component(spark, d):
    """a folder name anywhere."""
    return _filtered(spark, d, "in:fr").select("id", "path")


def filter_page(spark, d):
    """Filters before order and limit."""
    return _filtered(spark, d, "ext:.md").orderBy("name", "id").limit(25).select("id", "name")


def location_rules(spark, d):
    """The innermost location decides whether content is read."""
    rules = inventory.rules_for(M.files(spark, d).select("id", "path"), [("/src1", True), ("/src1/en", False), ("/src2", True)], ["/src2/de"])
    return rules.select("id", "covered", "content")


# --- names lane ---------------------------------------------------------------------------------


def names_search(spark, d):
    """Candidates by text, all tiers with typos, priors, top 30."""
    return _round(names.search(M.names(spark, d), Q.name_batch(spark, NAME_QUERIES), NOW_MS).drop("name", "path"), base=6, score=6)


def names_tiers(spark, d):
    """N2, N5 (exact, stem, prefix), N7, J11: the tiers that SQL expresses, with priors."""
    pairs = names.base_scores(names.candidates(names.indexed(M.names(spark, d)), Q.name_batch(spark, NAME_QUERIES)))
    pairs = pairs.where(F.col("name_key").startswith(F.col("key")) | (F.col("stem") == F.col("key")))
    score = F.col("base") + names.prior(NOW_MS, F.col("source"), F.col("modified"), F.col("attributes"), F.col("path"))
    return pairs.select("query_id", "id", F.round("base", 6).alias("base"), F.round(score, 6).alias("score"), "match")


def names_tokens(spark, d):
    """N3, N5 (token tiers): every query token begins a name token of its own, or a folder's."""
    pairs = names.base_scores(names.candidates(names.indexed(M.names(spark, d)), Q.name_batch(spark, NAME_QUERIES)))
    return pairs.where((F.col("match") == "prefix") & ~F.col("name_key").startswith(F.col("key"))).select("query_id", "id", (F.col("base") < 0.65).alias("by_folder"))


# --- contents lane ------------------------------------------------------------------------------


def _scored(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def bm25_all_terms(spark, d):
    """Rows with all terms, scored by BM25."""
    docs = contents.tokenized(M.chunks(spark, d))
    terms = _terms(spark, {"c1": ["the", "of"], "c2": ["tion", "and"], "c3": ["que", "de", "la"], "c4": ["der", "die"]})
    return _scored(contents.bm25(docs, terms))


def _terms(spark: SparkSession, batch: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(q, k, [w], False, len(ws)) for q, ws in batch.items() for k, w in enumerate(ws)], "query_id string, term int, words array<string>, prefix boolean, n_terms int")


def bm25_top(spark, d):
    """The ten best rows of each query."""
    docs = contents.tokenized(M.chunks(spark, d))
    return _scored(contents.top(contents.bm25(docs, Q.term_batch(spark, {"t1": "thing", "t2": "tion edth", "t3": "quand"})), 10))


def bm25_prefix(spark, d):
    """The last word as a prefix."""
    return _scored(contents.bm25(contents.tokenized(M.chunks(spark, d)), Q.term_batch(spark, PREFIX_QUERIES, typing=True)))


def bm25_two_of(spark, d):
    """Rows with any two of the first six content words."""
    return _scored(contents.bm25(contents.tokenized(M.chunks(spark, d)), Q.term_batch(spark, PAIR_QUERIES, pairs=True), pairs=True))


def bm25_phrase(spark, d):
    """C4: phrases beside words."""
    return _scored(contents.bm25(contents.tokenized(M.chunks(spark, d)), Q.term_batch(spark, PHRASE_QUERIES)))


def bm25_filtered(spark, d):
    """Metadata filters before the rank; row and term counts stay over all rows."""
    docs, terms = contents.tokenized(M.chunks(spark, d)), _terms(spark, {"c1": ["the", "and"]})
    allowed = docs.join(_filtered(spark, d, "ext:md").select(F.col("id").alias("item_id")), "item_id", "left_semi").select(F.lit("c1").alias("query_id"), "chunk_id")
    return _scored(contents.top(contents.bm25(docs, terms, allowed=allowed), 20))


def contents_lane(spark, d):
    """One result for each file with its confidence."""
    docs = contents.tokenized(M.chunks(spark, d))
    out = contents.lane(docs, Q.term_batch(spark, PAIR_QUERIES), Q.term_batch(spark, PAIR_QUERIES, pairs=True))
    return _round(out.drop("chunk_id"), confidence=6)


# --- vectors ------------------------------------------------------------------------------------


def _queries(v: DataFrame) -> DataFrame:
    return v.where(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "vector")


def vector_top_k(spark, d):
    """Exact top ten of every hundredth vector."""
    v = M.vectors(spark, d)
    return _round(vectors.top_k(v, _queries(v), 10), similarity=5)


def vector_normalize(spark, d):
    """V2: the first 32 dimensions at unit length."""
    v = M.vectors(spark, d)
    n = vectors.normalized(F.col("vector"), 32)
    return v.select("chunk_id", F.round(F.get(n, F.lit(0)), 6).alias("first"), F.round(F.get(n, F.lit(31)), 6).alias("last"))


def vector_two_tier(spark, d):
    """Snapshot rows unless written again later, newer writes, then the top five."""
    v = M.vectors(spark, d).withColumn("seq", F.col("chunk_id") + 1)
    again = v.where("chunk_id % 10 = 3").select("chunk_id", (F.col("seq") + 1_000_000).alias("seq"), F.transform("vector", lambda x: -x).alias("vector"))
    gone = v.where("chunk_id % 10 = 7").select("chunk_id", (F.col("seq") + 2_000_000).alias("seq"), F.lit(None).cast("array<float>").alias("vector"))
    live = vectors.current(v.select("chunk_id", "seq", "vector"), again.unionByName(gone), 1_000_000)
    return _round(vectors.top_k(live, _queries(v), 5), similarity=5)


def vector_rebuild(spark, d):
    """Whether index snapshots are due, by label as generation."""
    g = M.vectors(spark, d).groupBy("label").agg(F.count("*").alias("stored"), F.count(F.when(F.col("chunk_id") % 3 == 0, 1)).alias("delta"), F.count(F.when(F.col("chunk_id") % 4 == 0, 1)).alias("stale"))
    due = vectors.rebuild_due(F.col("stored") * 100, F.col("stored") * 70, F.col("delta") * 100, F.col("stale") * 60, F.col("label") % 2 == 0, F.lit(False))
    return g.select("label", due.alias("due"))


def vector_sequence(spark, d):
    """Writes numbered in order after the last one."""
    v = M.vectors(spark, d).select("chunk_id", "label")
    return vectors.write_sequence(v, 500, "label", "chunk_id").select("chunk_id", F.col("seq").cast("long").alias("seq"))


def vector_pending(spark, d):
    """Chunks without a vector, and queue counts by kind."""
    c = M.chunks(spark, d).select("chunk_id", "item_id")
    v = c.where("item_id % 3 = 0").select("chunk_id", F.when(F.col("item_id") % 2 == 0, 1).alias("vector"), F.when(F.col("item_id") % 2 == 1, "failed").alias("error_code"))
    return metrics.queue(c, v)


def vector_ivf(spark, d):
    """An inverted-file index over all rows, searched in 18 of its 24 cells; the README has its recall."""
    v = M.vectors(spark, d)
    centres = vectors.centroids(v, 24)
    return _round(vectors.ivf_search(vectors.ivf_index(v, centres), centres, _queries(v), 10, 18), similarity=5)


def meaning_lane(spark, d):
    """Hits from 0.15 up and within 0.15 of the query's best, one for each item."""
    v = M.vectors(spark, d)
    hits = vectors.top_k(v, _queries(v), 90, floor=0.15)
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    one = hits.withColumn("best", best).where("similarity >= best - 0.15").withColumn("item_id", F.floor(F.col("chunk_id") / 4))
    top = one.groupBy("query_id", "item_id").agg(F.max("similarity").alias("confidence"))
    return _round(top, confidence=5)


# --- usage --------------------------------------------------------------------------------------


def usage_frecency(spark, d):
    """Decayed scores of all uses."""
    s = usage.statistics(M.uses(spark, d))
    return s.select("item_id", "uses", "last_used_at", F.round(usage.frecency(F.col("rank_key"), EVENT_NOW), 6).alias("frecency"))


def usage_learned(spark, d):
    """Items opened for each beginning of a query."""
    return usage.choices(usage.learned(M.uses(spark, d))).select("query_key", "item_id", "uses", "last_used_at", "rank_no")


def _pins(uses: DataFrame) -> DataFrame:
    return uses.where("item_id % 17 = 0").groupBy("item_id").agg(F.min("at").alias("pinned_at"))


def usage_suggestions(spark, d):
    """Pins first, then used items."""
    u = M.uses(spark, d)
    return _round(usage.suggestions(usage.statistics(u), _pins(u)), score=6)


def usage_signals(spark, d):
    """Pins, decayed use and choices of candidates, as a prior."""
    u = M.uses(spark, d)
    ids = u.select(F.concat_ws("-", F.lit("q"), "item_id").alias("query_id"), F.col("item_id").alias("id")).distinct().withColumn("query_key", F.lit("q purchase"))
    s = usage.signals(ids, usage.statistics(u), _pins(u), usage.learned(u), EVENT_NOW)
    return s.select("id", "pinned", F.round("frecency", 6).alias("frecency"), "query_uses", F.round(names.usage_prior(F.col("pinned"), F.col("frecency"), F.col("query_uses")), 6).alias("prior"))


def usage_pruned(spark, d):
    """Uses since a day; pins stay."""
    u = M.uses(spark, d)
    return usage.pruned(usage.statistics(u), 1_706_400_000_000).select("item_id", "uses", "last_used_at")


# --- inventory ----------------------------------------------------------------------------------


def _catalogue(spark, d) -> DataFrame:
    f = M.files(spark, d)
    return f.select("id", F.lit("files").alias("source"), "path", "kind", "extension", "size", "modified", F.lit(1).alias("volume"), (F.col("id") + 7000).alias("file"), "attributes", F.lit(None).cast("long").alias("created"), F.lit("indexed").alias("content_state"))


def _pass(spark, d) -> DataFrame:
    """What a later pass sees: of ten files one is gone, one moved, one grown, one new, one only written."""
    c, k = _catalogue(spark, d), F.col("id") % 10
    moved = F.when(k == 2, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path"))
    seen = c.where(k != 1).select("source", moved.alias("path"), "kind", "extension", F.when(k == 3, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified", "volume", "file", "attributes", "created", (k == 5).alias("written"))
    new = c.where(k == 4).select("source", F.concat("path", F.lit(".new")).alias("path"), "kind", "extension", "size", "modified", "volume", (F.col("file") + 500_000_000).alias("file"), "attributes", "created", F.lit(False).alias("written"))
    return seen.unionByName(new)


def inventory_merge(spark, d):
    """Refreshed, moved and new items and what has to be read again."""
    return inventory.merge(_catalogue(spark, d), _pass(spark, d), 10_000_000).select("id", "path", "action", "invalid", "content_state")


def inventory_counts(spark, d):
    """What a pass did."""
    m = inventory.merge(_catalogue(spark, d), _pass(spark, d), 10_000_000)
    return m.groupBy("action").agg(F.count("*").alias("n"), F.count(F.when(F.col("invalid"), 1)).alias("invalid"))


def inventory_removed(spark, d):
    """Unseen items, but for those in folders that couldn't be listed."""
    unlisted = spark.createDataFrame([("/src1",), ("/src2/en",)], "path string")
    seen = _pass(spark, d)
    moved = _catalogue(spark, d).where("id % 10 != 2")
    return inventory.removed(moved, seen, unlisted).select("id", "path")


def cascade_delete(spark, d):
    """What is left after deleting items."""
    gone = M.files(spark, d).where("id % 4 = 0").select("id")
    c, u = M.chunks(spark, d).select("chunk_id", "item_id"), M.uses(spark, d)
    v = M.vectors(spark, d).select("chunk_id")
    left = inventory.cascade(gone, c, v, usage.statistics(u), _pins(u))
    out = None
    for name, table in zip(("chunks", "vectors", "usage", "pins"), left):
        row = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def scan_exclusions(spark, d):
    """The rule that leaves out each entry, counted."""
    s = F.col("id") % 6
    f = M.files(spark, d).withColumn("folder", F.concat(F.lit("/r"), (F.col("id") % 20).cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("/node_modules", "/build", "/venv", "/docs", "/Private", "/keep/target")]), (s + 1).cast("int"))))
    entries = f.select(F.concat("folder", F.lit("/"), "name").alias("path"), F.lit(False).alias("is_dir"))
    folders = f.select(F.col("folder").alias("path"), F.lit(True).alias("is_dir")).distinct()
    markers = spark.createDataFrame([("/r1/Cargo.toml", False), ("/r2/venv/pyvenv.cfg", False), ("/r3/app.csproj", False), ("/r7/build.gradle.kts", False)], "path string, is_dir boolean")
    every = entries.unionByName(folders).unionByName(markers)
    ruled = inventory.excluded(every, ["private"], ["pdf"], ["/r5/docs"])
    label = F.when(F.col("rule").startswith("below:"), "below").otherwise(F.coalesce("rule", F.lit("kept")))
    return ruled.groupBy(label.alias("rule")).agg(F.count("*").alias("n"))


def scan_roots(spark, d):
    """Roots without repeats and nested ones."""
    f = M.files(spark, d)
    paths = f.where("id % 5 = 0").select("path").unionByName(f.where("id % 40 = 0").select(inventory.parent_of(F.col("path")).alias("path")))
    return inventory.roots(paths)


def nearest_repository(spark, d):
    """The nearest marked folder above each file."""
    marked = spark.createDataFrame([("/src1",), ("/src1/en",), ("/src3/fr",)], "folder string")
    return inventory.nearest_marked(M.files(spark, d).select("id", "path"), marked).select("id", "repository")


def content_candidates(spark, d):
    """K9: files to read again."""
    f = M.files(spark, d)
    own = X.fingerprint(F.col("size"), F.col("modified"))
    s = F.col("id") % 6
    f = f.withColumns({"content_state": F.when(s == 0, F.lit(None)).when(s == 1, "failed").otherwise("indexed"), "extractor": F.when(s == 2, 1).otherwise(2), "fingerprint": F.when(s == 3, F.lit("0:0")).otherwise(own), "status": F.when(F.col("id") % 13 == 0, "error").otherwise("indexed")})
    return chunking.changed(f, 2).select("id")


# --- aggregates and metrics ---------------------------------------------------------------------


def content_counts(spark, d):
    """A1, A2: coverage by content state and scope."""
    s = F.col("id") % 6
    f = M.files(spark, d).withColumn("content_state", F.when(s == 0, F.lit(None)).when(s == 1, "failed").when(s == 2, "skipped").otherwise("indexed"))
    return metrics.coverage(f, ["md", "txt"], F.col("path").startswith("/src1"))


def retrieval_metrics(spark, d):
    """Recall, MRR, NDCG and top-1 of vector search, by shared labels."""
    v = M.vectors(spark, d)
    results = vectors.top_k(v, _queries(v), 11).where("query_id != chunk_id").select("query_id", F.col("chunk_id").alias("item_id"), "rank_no")
    labels = v.select("chunk_id", "label")
    asked = labels.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "label")
    judged = asked.join(labels, "label").where("query_id != chunk_id").select("query_id", F.col("chunk_id").alias("item_id"), F.when(F.col("chunk_id") % 3 == 0, 1).otherwise(2).alias("grade"))
    return _round(metrics.retrieval(results, judged), recall_1=6, recall_3=6, recall_k=6, mrr=6, ndcg=6, top_1=6)


def latency_percentiles(spark, d):
    """Nearest-rank percentiles."""
    return _round(metrics.percentiles(M.read(spark, d, "events"), "value", "event_type"), mean=6)


def generation_validity(spark, d):
    """Counts and self-recall decide whether a generation goes live."""
    v = M.vectors(spark, d)
    self_hits = vectors.top_k(v, _queries(v), 1).agg(F.avg((F.col("query_id") == F.col("chunk_id")).cast("double")).alias("r"))
    done = v.select("chunk_id", F.when(F.col("chunk_id") % 200 != 1, 1).alias("vector"), F.when(F.col("chunk_id") % 200 == 1, "failed").alias("error_code"))
    counted = metrics.queue(v, done).join(F.broadcast(self_hits))  # one row
    total = F.col("done") + F.col("failed") + F.col("pending")
    return counted.select("done", "failed", "pending", F.round("r", 6).alias("self_recall"), ((F.col("pending") == 0) & (F.col("failed") * 100 <= total) & (F.col("r") >= 0.95)).alias("valid"))


def chunk_refs(spark, d):
    """Chunks in a given order, missing ones dropped."""
    ids = spark.createDataFrame([([300_000, 1, 100_000, 99_999_999_999, 0, 200_000],)], "ids array<long>").select(F.posexplode("ids").alias("position", "chunk_id"))
    return ids.join(M.chunks(spark, d), "chunk_id").select("position", "chunk_id", F.substring("text", 1, 40).alias("excerpt"))


# --- fusion -------------------------------------------------------------------------------------


def _lanes(spark, d) -> DataFrame:
    """Three lanes over the same items: by name, by passage, by vector."""
    f = M.files(spark, d)
    asked = {"q1": "thing tion", "q2": "ciones", "q3": "doc_1"}
    batch = Q.name_batch(spark, asked)
    items = f.select("id", F.lit("files").alias("source"), "name", X.fold_key(F.col("name")).alias("name_key"), "path", "modified", "attributes")
    n = names.search(items, batch, NOW_MS).select("query_id", F.lit("names").alias("lane"), F.col("id").alias("item_id"), "rank_no", F.col("base").alias("confidence"), "match", F.col("name").alias("title"), F.col("path").alias("subtitle"), F.lit(None).cast("string").alias("passage"))
    docs = contents.tokenized(M.chunks(spark, d))
    c = contents.lane(docs, Q.term_batch(spark, asked)).join(docs.select("chunk_id", "text"), "chunk_id").join(f.select(F.col("id").alias("item_id"), "name"), "item_id")
    c = c.select("query_id", F.lit("contents").alias("lane"), "item_id", "rank_no", "confidence", F.lit("content").alias("match"), F.col("name").alias("title"), F.lit(None).cast("string").alias("subtitle"), X.one_line(F.col("text")).alias("passage"))
    v = M.vectors(spark, d)
    probes = v.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), "vector")
    m = vectors.top_k(v, probes, 30).withColumn("item_id", F.col("chunk_id")).join(f.select(F.col("id").alias("item_id"), "name"), "item_id")
    m = m.select(F.concat(F.lit("q"), (F.col("query_id") + 1).cast("string")).alias("query_id"), F.lit("meaning").alias("lane"), "item_id", "rank_no", F.col("similarity").alias("confidence"), F.lit("meaning").alias("match"), F.col("name").alias("title"), F.lit(None).cast("string").alias("subtitle"), F.lit(None).cast("string").alias("passage"))
    return n.unionByName(c).unionByName(m)


def search_fused(spark, d):
    """Names, contents and meaning fused; the flagship."""
    return _round(fusion.fuse(_lanes(spark, d)), score=9, confidence=5)


def fusion_rrf(spark, d):
    """Fusion of three ranked lanes made from the tables."""
    f = M.files(spark, d)
    q = F.concat(F.lit("q"), (F.col("id") % 3).cast("string"))
    lanes = None
    for name, key, kind in (("names", F.col("size"), F.when(F.col("id") % 50 == 0, "exact").otherwise("prefix")), ("contents", -F.col("modified"), F.lit("content")), ("meaning", F.col("modified") * 7919 % 10007, F.lit("meaning"))):
        order = Window.partitionBy("query_id").orderBy("key", "id")
        lane = f.select(q.alias("query_id"), "id", key.alias("key"), kind.alias("match"), "name", F.when(F.col("id") % 4 == 0, F.col("path")).alias("path")).withColumn("rank_no", F.row_number().over(order)).where("rank_no <= 60")
        lane = lane.select("query_id", F.lit(name).alias("lane"), F.col("id").alias("item_id"), "rank_no", (1 / (1 + F.col("rank_no"))).alias("confidence"), "match", F.col("name").alias("title"), F.col("path").alias("subtitle"), F.lit(None).cast("string").alias("passage"))
        lanes = lane if lanes is None else lanes.unionByName(lane)
    return _round(fusion.fuse(lanes).drop("passage", "lanes"), score=9, confidence=6)


def result_violations(spark, d):
    """Results that break the contract."""
    f = M.files(spark, d)
    i = F.col("id")
    actions = F.when(i % 9 == 0, F.array(F.lit("open"), F.lit("fly"))).when(i % 9 == 1, F.array(F.lit("open"), F.lit("open"))).otherwise(F.array(F.lit("open"), F.lit("reveal")))
    rows = f.select(F.lit("q").alias("query_id"), i.alias("item_id"), F.when(i % 9 == 2, F.lit(" ")).otherwise(F.col("name")).alias("title"), F.when(i % 9 == 3, 1.5).otherwise(0.5).alias("confidence"), actions.alias("actions"), F.when(i % 9 == 4, "run_as_admin").otherwise("open").alias("primary"))
    return fusion.violations(rows)


# --- chunking and streams -----------------------------------------------------------------------


def chunk_documents(spark, d):
    """K1-K8: chunks of all documents by kind, with byte offsets."""
    docs = M.spread(M.read(spark, d, "documents").select("doc_id", "text"))
    kind = F.coalesce(chunking.kind_of(M.extension(F.col("doc_id"))), F.lit("prose"))
    return chunking.chunk(docs.select(F.col("doc_id").alias("item_id"), kind.alias("kind"), "text")).drop("text")


def _hints(spark, d) -> DataFrame:
    e = M.read(spark, d, "events")
    action = F.when(F.col("event_type") == "click", "modify").when(F.col("event_type") == "purchase", "create").when(F.col("event_type") == "error", "lost").when(F.col("event_type") == "signup", "rename").otherwise("access")
    return e.select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), action.alias("action"), (F.col("event_id") % 2 == 0).alias("recursive"), (F.col("event_id") % 3 == 0).alias("content"), F.col("ts").cast("timestamp").alias("ts"))


def change_hints(spark, d):
    """Hints put together by path."""
    return changes.coalesced(_hints(spark, d))


def change_passes(spark, d):
    """Passes after a quiet gap, and which rescan."""
    return changes.passes(_hints(spark, d)).select(F.col("start").cast("timestamp_ntz").alias("start"), "hints", "rescan")


def usage_stream_fold(spark, d):
    """Sums as a stream keeps them, folded; equals usage_frecency."""
    s = usage.folded(stream_usage.running(M.uses(spark, d)))
    return s.select("item_id", "uses", "last_used_at", F.round(usage.frecency(F.col("rank_key"), EVENT_NOW), 6).alias("frecency"))


# --- states -------------------------------------------------------------------------------------


def _images(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items with image columns, their units, the vectors of the active generation and recognised texts, by fixed rules over ids."""
    i = F.col("id")
    case = lambda n, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (i % n + 1).cast("int"))
    items = M.files(spark, d).withColumns({
        "content_state": case(6, "indexed", "indexed", "indexed", "skipped", "failed", None), "content_error": F.when(i % 12 == 3, "image:decode").when(i % 12 == 4, "image:io").when(i % 12 == 9, "text:binary"),
        "image_width": F.when(i % 5 != 4, 640), "image_digest": F.when(i % 7 != 6, F.concat(F.lit("d"), i.cast("string"))), "status": F.when(i % 13 == 0, "error").otherwise("indexed"),
    })
    chunks = items.where("id % 4 != 3").select(F.col("id").alias("item_id"), (i * 10).alias("chunk_id"), F.when(i % 8 == 1, "prose").otherwise("image").alias("kind"), F.when(i % 9 == 0, "").otherwise("seen").alias("text"))
    vectors_ = chunks.where("item_id % 3 != 2").select("chunk_id", F.when(F.col("item_id") % 3 == 0, 1).alias("vector"), F.when(F.col("item_id") % 3 == 1, "failed").alias("error_code"))
    o = F.col("item_id")
    ocr = chunks.where("item_id % 10 != 7").select("item_id", F.concat(F.lit("d"), (o + F.when(o % 11 == 0, 1).otherwise(0)).cast("string")).alias("source_digest"), F.when(o % 17 == 0, 0).otherwise(states.OCR_VERSION).alias("version"), F.element_at(F.array(*[F.lit(x) for x in ("indexed", "empty", "skipped", "failed")]), (o % 4 + 1).cast("int")).alias("state"))
    return items, chunks, vectors_, ocr


def image_states(spark, d):
    """The state of every item's image."""
    items, chunks, vectors_, _ = _images(spark, d)
    return states.image_states(items, chunks, vectors_).select("id", "image_state")


def image_counts(spark, d):
    """A4: image units by state."""
    items, chunks, vectors_, _ = _images(spark, d)
    return states.image_counts(items, chunks, vectors_)


def ocr_counts(spark, d):
    """Recognised texts in a scope by state; stale ones are pending."""
    items, chunks, _, ocr = _images(spark, d)
    return states.ocr_counts(items, chunks, ocr, F.col("path").startswith("/src1"))


def ocr_candidates(spark, d):
    """Images whose text is to be recognised."""
    items, chunks, _, ocr = _images(spark, d)
    return states.ocr_candidates(items, chunks, ocr)


def _code_items(spark, d) -> tuple[DataFrame, DataFrame]:
    i = F.col("id")
    items = M.files(spark, d).withColumns({
        "source": F.lit("files"), "status": F.when(i % 13 == 0, "error").otherwise("indexed"), "attributes": F.when(i % 6 == 0, 4).otherwise(F.col("attributes")), "language": F.when(i % 3 == 0, "python"),
        "repository": F.when(i % 3 == 0, F.lit("/r")), "context_path": F.when(i % 3 == 0, F.col("path")).when(i % 3 == 1, F.lit("/old")),
    })
    return items, items.where("extension = 'py'").select(F.col("id").alias("item_id"), F.when(i % 4 == 0, "text").otherwise("code").alias("kind"))


def code_candidates(spark, d):
    """Code files whose stored context is not of their path."""
    return states.code_candidates(*_code_items(spark, d)).select("id", "path")


def code_context(spark, d):
    """Context stored where the path is still the same, then cleared in a folder."""
    items, _ = _code_items(spark, d)
    found = items.where("id % 3 = 1").select("id", F.when(F.col("id") % 2 == 0, F.col("path")).otherwise(F.lit("/moved")).alias("path"), F.lit("rust").alias("language"), F.lit("/new").alias("repository"))
    return states.without_code_context(states.with_code_context(items, found), "/src1/en").select("id", "language", "repository", "context_path")


def code_search_context(spark, d):
    """What is searched beside code, and its passage's place."""
    n = M.names(spark, d)
    kind, language = F.when(F.col("id") % 3 == 0, "text").otherwise("code"), F.when(F.col("id") % 2 == 0, "rust")
    return n.select("id", states.search_context(kind, F.array_join(X.code_tokens(F.col("name")), " "), F.array_join(X.path_tokens(F.col("path")), " "), F.col("name"), language).alias("context"))


def item_status(spark, d):
    """The next status and attribute bits of entries with and without errors."""
    f, i = M.files(spark, d), F.col("id")
    status = states.next_status(F.when(i % 4 == 0, "error").when(i % 4 == 1, "pending").otherwise("indexed"), F.when(i % 5 == 0, "metadata"))
    return f.select("id", status.alias("status"), states.attribute_bits(i % 2 == 0, i % 3 == 0, F.when(i % 7 != 0, i % 5 == 0)).alias("attributes"))


def skip_reasons(spark, d):
    """Why files aren't read, counted."""
    docs = M.spread(M.read(spark, d, "documents").select("doc_id", "text"))
    head = F.concat(F.when(F.col("doc_id") % 9 == 0, F.unhex(F.lit("610062"))).when(F.col("doc_id") % 9 == 1, F.unhex(F.lit("FFFE6100"))).otherwise(F.unhex(F.lit(""))), F.substring(F.col("text").cast("binary"), 1, 64))
    reason = states.skip_reason(chunking.kind_of(M.extension(F.col("doc_id"))), F.octet_length("text"), head, 4000)
    return docs.groupBy(F.coalesce(reason, F.lit("read")).alias("reason")).agg(F.count("*").alias("n"))


def content_same(spark, d):
    """Whether stored chunks equal those read again: one changed, one more, one fewer of each ten items."""
    c, k = M.chunks(spark, d).select("item_id", "ordinal", "text"), F.col("item_id") % 10
    read = c.where((k != 3) | (F.col("ordinal") > 0)).withColumn("text", F.when((k == 4) & (F.col("ordinal") == 0), F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    more = c.where((k == 5) & (F.col("ordinal") == 0)).withColumn("ordinal", F.lit(1_000_000))
    return states.content_matches(c, read.unionByName(more), "text")


def offered_actions(spark, d):
    """Actions by place: the primary one, then by group."""
    i = F.col("id")
    rows = M.files(spark, d).select(F.lit("q").alias("query_id"), i.alias("item_id"), F.when(i % 3 == 0, "reveal").otherwise("open").alias("primary"), F.array(*[F.lit(x) for x in ("pin", "copy_path", "open", "fly", "reveal")]).alias("secondary"), F.when(i % 4 == 0, F.array(F.lit("pin"), F.lit("reveal"))).otherwise(F.array(*[F.lit(x) for x in ("open", "reveal", "copy_path", "pin", "fly")])).alias("allowed"))
    return states.offered_actions(rows)


def user_exclusions(spark, d):
    """what the user's rules leave out: a folder, a folder name below a location, an extension."""
    f = M.files(spark, d)
    return f.where(states.user_excluded(F.col("path"), F.lit(False), F.col("extension"), ["/src1", "/src2"], ["/src3/de"], ["EN"], ["csv"])).select("id", "path")


def location_states(spark, d):
    """what a pass found for each location."""
    roots = spark.createDataFrame([("/src0",), ("/src1",), ("/src2",), ("/none",)], "path string")
    issues = spark.createDataFrame([("/none", "open_root")], "path string, stage string").unionByName(M.files(spark, d).where("id % 50 = 0 and path not like '/src2/%'").select("path", F.lit("list").alias("stage")))
    return states.location_states(roots, issues)


def index_records(spark, d):
    """Generations by label, the promotion of the newest that is ready, and whether the active one's index can be used."""
    g = M.vectors(spark, d).groupBy(F.col("label").alias("generation")).agg(F.count("*").alias("rows"))
    rows = g.withColumn("state", F.when(F.col("generation") == 0, "active").otherwise("building"))
    now = states.promoted(rows.select("generation", "state"), rows.where("generation % 3 != 0").select("generation"))
    records = g.select("generation", F.concat(F.lit("g"), F.col("generation").cast("string")).alias("file"), F.lit(states.index_fingerprint(64)).alias("fingerprint"), "rows", F.col("rows").alias("file_rows"))
    index = states.usable_indexes(now, records, states.index_fingerprint(64))
    return now.join(index, "generation", "left")


def space_keys(spark, d):
    """The key of an embedding space."""
    v = M.vectors(spark, d)
    return v.select("chunk_id", states.space_key(F.lit("mock"), F.concat(F.lit("r"), F.col("label").cast("string")), F.lit(1), F.lit("search"), F.col("label"), F.size("vector")).alias("space"))


def names_learned(spark, d):
    """Names with usage: learned items are candidates without a match too (base 0.6), and use raises the score."""
    asked = {"u1": "red", "u2": "zzz", "u3": '"red bolt"'}
    batch = Q.name_batch(spark, asked)
    n = M.names(spark, d)
    learned = n.where("id % 100 = 7").select("id", F.explode(F.array(*[F.lit(q) for q in asked])).alias("query_id"))
    signals = learned.select("query_id", "id", (F.col("id") % 200 == 7).alias("pinned"), F.lit(2.0).alias("frecency"), F.lit(3).alias("query_uses"))
    out = names.search(n, batch, NOW_MS, 10, signals, learned)
    return _round(out.drop("name", "path"), base=6, score=6)


def embed_chunks(spark, d):
    """Vectors of the hashing embedder; texts it can't embed get an error of their own."""
    c = M.read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 2, " ").otherwise(F.col("text")).alias("text"))
    e = c.select("conv_id", "turn", embed("text").alias("e"))
    return e.select("conv_id", "turn", F.size("e.vector").alias("dims"), F.round(F.sqrt(vectors.dot(F.col("e.vector"), F.col("e.vector"))), 3).alias("norm"), F.col("e.error_code").alias("error_code"))


def item_lookup(spark, d):
    """Items by id and by path, with the number of items of their source."""
    f = M.files(spark, d).withColumn("source", F.split("path", "/")[1])
    hit = f.where(F.col("id").isin(3, 30) | (F.col("path") == "/src1/en/doc_0.txt") | (F.col("name") == "doc_7.csv"))
    return hit.join(f.groupBy("source").agg(F.count("*").alias("items")), "source").select("id", "path", "items")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "queries"}
    return {"search_fused": own.pop("search_fused")} | own
