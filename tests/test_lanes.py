"""Names, contents (against SQLite's FTS5), vectors, fusion."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import contents, fusion, metrics, names, vectors
from quarry.plans import query as Q
from quarry.streaming import changes


def _items(spark, rows):
    df = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(rows)], "id long, name string, path string")
    return df.select("id", F.lit("files").alias("source"), "name", X.fold_key(F.col("name")).alias("name_key"), "path", F.lit(None).cast("long").alias("modified"), F.lit(0).alias("attributes"))


def _score(spark, query, *rows):
    rows = [r if isinstance(r, tuple) else (r, f"/r/{r}") for r in rows]
    out = names.search(_items(spark, rows), Q.name_batch(spark, {"q": query}), 0).collect()
    return {r.name: (round(r.base, 4), r.match) for r in out}


def test_tiers_in_order(spark):
    everything = {}
    for q, n in (("notes.txt", "notes.txt"), ("notes", "notes.txt"), ("not", "notes.txt"), ("visual code", "Visual Studio Code"), ("studio code", "Visual Studio Code"), ("vsc", "Visual Studio Code"), ("spotfy", "Spotify")):
        everything[q] = _score(spark, q, n)[n]
    bases = [everything[q][0] for q in ("notes.txt", "notes", "not", "visual code", "studio code", "spotfy")]
    assert bases == sorted(bases, reverse=True) and len(set(bases)) == 6
    assert everything["notes.txt"] == (1.0, "exact") and everything["notes"] == (0.97, "exact")
    assert everything["spotfy"] == (0.37, "fuzzy") and everything["vsc"][1] == "prefix"
    assert _score(spark, "xyz", "Visual Studio Code") == {}


def test_code_names_folders_phrases(spark):
    assert _score(spark, "compo", "MyComponentName.tsx")
    assert _score(spark, "budget 2025", "q3budget2025.xlsx")
    assert _score(spark, "http serv", "HTTPServer.rs")
    assert _score(spark, "lumi notas", ("notas.md", "/home/x/lumi/notas.md"))["notas.md"] == (0.55, "prefix")
    assert _score(spark, "lumi x", ("notas.md", "/home/x/lumi/notas.md")) == {}
    assert _score(spark, '"studio code"', "Visual Studio Code", "Code Studio") .keys() == {"Visual Studio Code"}


def test_priors(spark):
    df = spark.createDataFrame([("apps", 0, 0, "/a"), ("files", 0, 3, "/a/b/c/d/e/f/g"), ("files", -20 * names.DAY_MS, 0, "/a"), ("files", None, 0, "/a")], "s string, m long, a int, p string")
    got = [round(r.x, 4) for r in df.select(names.prior(0, F.col("s"), F.col("m"), F.col("a"), F.col("p")).alias("x")).collect()]
    assert got == pytest.approx([0.1, 0.04 - 0.15 - 0.012, 0.02, 0.0])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "alp", "betamax", "eps", "zeta", "eta", "theta"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(120)]


@pytest.mark.parametrize("text, typing, pairs", [("alpha beta", False, False), ("gamma alp", True, False), ('"alpha beta" zeta', False, False), ("alpha eps zeta theta", False, True), ("nothing", False, False)])
def test_bm25_equals_fts5(spark, corpus, text, typing, pairs):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(body, tokenize=\"unicode61 remove_diacritics 2\")")
    con.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(corpus, 1)))
    found = (Q.pair_terms if pairs else Q.content_terms)(text, typing)
    quoted = [f'"{" ".join(t.words)}"' + ("*" if t.prefix else "") for t in found]
    match = " OR ".join(f"({a} {b})" for i, a in enumerate(quoted) for b in quoted[i + 1 :]) if pairs else " ".join(quoted)
    want = {i: s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}
    docs = contents.tokenized(spark.createDataFrame(list(enumerate(corpus, 1)), "chunk_id long, text string"))
    got = {r.chunk_id: r.score for r in contents.bm25(docs, Q.term_batch(spark, {"q": text}, typing, pairs), pairs=pairs).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_bm25_with_column_weights_equals_fts5(spark, corpus):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, b)")
    rows = [(i, corpus[i], corpus[-i - 1]) for i in range(60)]
    con.executemany("insert into t(rowid, a, b) values (?, ?, ?)", rows)
    want = dict(con.execute("select rowid, bm25(t, 1.0, 0.25) from t where t match '\"zeta\" \"eta\"'").fetchall())
    docs = contents.tokenized(spark.createDataFrame(rows, "chunk_id long, a string, b string"), "a", "b")
    got = {r.chunk_id: r.score for r in contents.bm25(docs, Q.term_batch(spark, {"q": "zeta eta"}), (1.0, 0.25)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_lane_gives_one_result_for_each_item(spark):
    rows = [(1, 10, "red fox"), (2, 10, "red red fox"), (3, 20, "red owl grey"), (4, 30, "nothing here"), (5, 40, "fox grey")]
    docs = contents.tokenized(spark.createDataFrame(rows, "chunk_id long, item_id long, text string"))
    t = {"q": "red fox grey"}
    out = contents.lane(docs, Q.term_batch(spark, t), Q.term_batch(spark, t, pairs=True)).orderBy("rank_no").collect()
    assert sorted(r.item_id for r in out) == [10, 20, 40]
    assert out[0].confidence == pytest.approx(0.9) and all(0.4 <= r.confidence <= 0.9 for r in out)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id long, vector array<float>")
    q = v.where("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), "vector")
    got = {(r.query_id, r.rank_no): r.chunk_id for r in vectors.top_k(v, q, 10).collect()}
    exact = np.argsort(-(x[:5].astype(float) @ x.T.astype(float)), axis=1, kind="stable")[:, :10]
    assert all(got[i, k + 1] == exact[i, k] for i in range(5) for k in range(10))
    centres = vectors.centroids(v, 8)
    ivf = {(r.query_id, r.chunk_id) for r in vectors.ivf_search(vectors.ivf_index(v, centres), centres, q, 10, 6).collect()}
    assert sum((i, c) in ivf for i in range(5) for c in exact[i]) >= 45
    halves = v.select(vectors.unpack_f16(vectors.pack_f16("vector")).alias("h"), "vector").first()
    assert np.allclose(halves.h, np.asarray(halves.vector, "f4").astype("f2").astype("f4"))
    bad = spark.createDataFrame([([0.0, 0.0],), ([float("nan"), 1.0],), ([3.0, 4.0],)], "v array<float>").select(vectors.normalized(F.col("v")).alias("n")).collect()
    assert [r.n for r in bad] == [None, None, [pytest.approx(0.6), pytest.approx(0.8)]]


def test_delta_validity(spark):
    snapshot = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [2.0]), (3, 3, [3.0]), (4, 9, [4.0])], "chunk_id long, seq long, vector array<double>")
    delta = spark.createDataFrame([(2, 6, [20.0]), (3, 7, None), (5, 8, [5.0])], "chunk_id long, seq long, vector array<double>")
    got = {r.chunk_id: r.vector for r in vectors.current(snapshot, delta, 5).collect()}
    assert got == {1: [1.0], 2: [20.0], 5: [5.0]}


def test_fusion(spark):
    ddl = "query_id string, lane string, item_id long, rank_no int, confidence double, match string, title string, subtitle string, passage string"
    rows = [
        ("q", "names", 1, 1, 0.9, "prefix", "one", "/one", None), ("q", "contents", 1, 3, 0.5, "content", "one", None, "text"), ("q", "meaning", 2, 1, 0.7, "meaning", "two", None, None),
        ("q", "names", 3, 9, 1.0, "exact", "three", None, None), ("q", "other", 4, 1, 1.0, "exact", "four", None, None),
    ]
    out = fusion.fuse(spark.createDataFrame(rows, ddl)).orderBy("position").collect()
    assert [r.item_id for r in out] == [3, 2, 1]
    one = out[2]
    assert one.score == pytest.approx(1 / 61 + 1 / 63) and one.lane == "names" and one.passage == "text" and one.subtitle == "/one"
    assert [r.item_id for r in fusion.fuse(spark.createDataFrame(rows, ddl), {"names": 1.0, "meaning": 0.0, "contents": float("nan")}).orderBy("position").collect()] == [3, 1]


def test_retrieval_metrics(spark):
    results = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("b", 9, 1)], "query_id string, item_id long, rank_no int")
    judged = spark.createDataFrame([("a", 2, 2), ("a", 3, 1), ("b", 8, 2)], "query_id string, item_id long, grade int")
    got = {r.query_id: r for r in metrics.retrieval(results, judged).collect()}
    assert (got["a"].recall_1, got["a"].recall_3, got["a"].mrr, got["a"].top_1) == (0.0, 1.0, 0.5, 0.0)
    assert got["a"].ndcg == pytest.approx((3 / np.log2(3) + 1 / np.log2(4)) / (3 + 1 / np.log2(3)))
    assert got["b"].ndcg == 0.0


def test_learned_items_of_a_query_with_phrases_are_no_exception(spark):
    """beyond the first limit * 5 only learned items get signals, and a query with phrases has none."""
    n = 12
    items = spark.createDataFrame([(i, "files", "red bolt", "red bolt", f"/a/{i}", 0, 0) for i in range(n)], "id long, source string, name string, name_key string, path string, modified long, attributes int")
    batch = Q.name_batch(spark, {"plain": "red bolt", "phrase": '"red bolt"'})
    learned = spark.createDataFrame([(q, n - 1) for q in ("plain", "phrase")], "query_id string, id long")
    signals = learned.selectExpr("query_id", "id", "true as pinned", "2.0d as frecency", "3 as query_uses")
    out = {(r.query_id, r.rank_no): r.id for r in names.search(items, batch, 10**13, 2, signals, learned).collect()}
    assert out == {("plain", 1): n - 1, ("plain", 2): 0, ("phrase", 1): 0, ("phrase", 2): 1}


@pytest.mark.parametrize("origin", [0, 59_999_900, 59_700_000])
def test_a_pass_ends_after_the_whole_quiet_gap(spark, origin):
    """a hint exactly 300 ms after the last begins a pass, also where a minute ends between them; hints at one instant stay together."""
    gaps = [0, 0, 299_999, 0, 300_000, 0, 299_999, 299_999, 120_000_000, 300_001]
    at = [origin + sum(gaps[: k + 1]) for k in range(len(gaps))]
    hints = spark.createDataFrame([(f"/u/{k % 3}", "modify", t) for k, t in enumerate(at)], "path string, action string, t long").select("path", "action", F.timestamp_micros("t").alias("ts"))
    got = sorted((r.s - origin, r.e - origin, r.hints, r.paths, r.rescan) for r in changes.passes(hints).select(F.unix_micros("start").alias("s"), F.unix_micros("end").alias("e"), "hints", "paths", "rescan").collect())
    assert got == [(0, 599_999, 4, 3, False), (599_999, 1_499_997, 4, 3, False), (121_199_997, 121_499_997, 1, 1, False), (121_499_998, 121_799_998, 1, 1, False)]


def test_a_pass_counts_its_paths_exactly(spark):
    """a table's pass rescans from 4,097 paths on, not by a sketch's guess."""
    hints = spark.range(4_096 * 3).selectExpr("concat('/p/', id % 4096) as path", "'modify' as action", "timestamp_micros(id) as ts")
    more = hints.unionByName(spark.range(1).selectExpr("'/p/new' as path", "'modify' as action", "timestamp_micros(5) as ts"))
    assert [(r.paths, r.rescan) for x in (hints, more) for r in changes.passes(x).collect()] == [(4_096, False), (4_097, True)]
