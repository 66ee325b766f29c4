"""Inventory, usage, chunking and streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, inventory, usage
from quarry.streaming import changes
from quarry.streaming import usage as stream_usage

ENTRY = "source string, path string, kind string, extension string, size long, modified long, volume int, file long, attributes int, created long, written boolean"
ITEM = "id long, source string, path string, kind string, extension string, size long, modified long, volume int, file long, attributes int, created long, content_state string"


def test_merge(spark):
    old = spark.createDataFrame([
        (1, "files", "/a", "file", "txt", 5, 10, 1, 100, 0, None, "indexed"), (2, "files", "/b", "file", "txt", 5, 10, 1, 200, 0, None, "indexed"),
        (3, "files", "/c", "file", "txt", 5, 10, 1, 300, 0, None, "indexed"), (4, "files", "/d", "file", "txt", None, None, None, None, 0, None, "indexed"), (5, "files", "/e", "file", "txt", 5, 10, 1, 100, 0, None, "indexed"),
    ], ITEM)
    seen = spark.createDataFrame([
        ("files", "/a", "file", "txt", 6, 11, 1, 100, 0, None, False), ("files", "/x/b", "file", "txt", 5, 10, 1, 200, 0, None, False), ("files", "/y/b", "file", "txt", 5, 10, 1, 200, 0, None, False),
        ("files", "/x/c", "file", "txt", 9, 10, 1, 300, 0, None, False), ("files", "/d", "file", "txt", None, None, None, None, 0, None, False), ("files", "/e", "file", "txt", 5, 10, 1, 100, 0, None, True),
    ], ENTRY)
    got = {r.path: (r.id, r.action, r.invalid, r.content_state) for r in inventory.merge(old, seen, 10).collect()}
    assert got["/a"] == (1, "updated", True, None)
    assert got["/x/b"] == (2, "moved", False, "indexed")
    assert got["/y/b"][1:] == ("inserted", False, None) and got["/x/c"][1] == "inserted"
    assert {got["/y/b"][0], got["/x/c"][0]} == {10, 11}
    assert got["/d"] == (4, "updated", False, "indexed")
    assert got["/e"] == (5, "updated", True, None)


def test_exclusions(spark):
    rows = [("/r", True), ("/r/build", True), ("/r/package.json", False), ("/r/build/x.js", False), ("/s/build", True), ("/s/venv", True), ("/t/venv", True), ("/t/venv/pyvenv.cfg", False), ("/s/a.LOG", False), ("/s/.log", False)]
    got = {r.path: r.rule for r in inventory.excluded(spark.createDataFrame(rows, "path string, is_dir boolean"), [], ["log"], []).collect()}
    assert got["/r/build"] == "build:build" and got["/r/build/x.js"] == "below:/r/build"
    assert got["/s/build"] is None and got["/s/venv"] is None and got["/t/venv"] == "default:venv"
    assert got["/s/a.LOG"] == "extension:.log" and got["/s/.log"] is None


def test_frecency(spark):
    now, day = 1_000 * usage.HALF_LIFE_MS, 86_400_000
    rows = [(1, 1.0, now), (1, 0.5, now - usage.HALF_LIFE_MS), (2, 0.3, now - 3 * day)]
    stats = usage.statistics(spark.createDataFrame(rows, "item_id long, weight double, at long"))
    got = {r.item_id: r.f for r in stats.select("item_id", usage.frecency(F.col("rank_key"), now).alias("f")).collect()}
    assert got[1] == pytest.approx(1.25, abs=1e-9) and got[2] == pytest.approx(0.3 * 2 ** (-3 / 14), abs=1e-9)
    merged = usage.merge(stats, stats).where("item_id = 1").first()
    assert merged.uses == 4 and math.exp(merged.rank_key - usage.DECAY * now) == pytest.approx(2.5, abs=1e-9)


def test_learned(spark):
    uses = spark.createDataFrame([(7, "primary", "ab c", 5), (7, "reveal", "ab c", 6), (8, "primary", "ab", 9)], "item_id long, use string, query_key string, at long")
    got = {(r.query_key, r.item_id): r.uses for r in usage.learned(uses).collect()}
    assert got == {("a", 7): 1, ("ab", 7): 1, ("ab c", 7): 1, ("a", 8): 1, ("ab", 8): 1}


def _bodies(text, kind, **limits):
    return [text[s.start : s.end] for s in chunking.chunks(text, kind, chunking.Limits(**limits))]


def test_prose_chunks():
    text = "One two. Three four!\n\nSecond paragraph here."
    assert _bodies(text, "prose") == [text]
    small = _bodies(text, "prose", target=4, most=4)
    assert small == ["One two.", "Three four!", "Second paragraph", "here."] or all(chunking.count_tokens(b) <= 4 for b in small)
    assert _bodies(" \n ", "prose") == []
    assert all(chunking.count_tokens(b) <= 10 for b in _bodies("x" * 500 + " " + "é!" * 300, "prose", target=8, most=10))


def test_markdown_chunks():
    text = "# A\n\n## B\nbody one\n\n```\n# not a heading\n```\n## C\nbody two\n"
    spans = chunking.chunks(text, "markdown")
    assert [s.context for s in spans] == ["A › B", "A › C"]
    assert "# not a heading" in text[spans[0].start : spans[0].end]


def test_code_chunks():
    text = "import x\n\ndef alpha():\n    a = 1\n    return a\n\n\nclass Beta:\n    def run(self):\n        return 2\n"
    spans = chunking.chunks(text, "code:python", chunking.Limits(target=14, most=40))
    assert [s.symbol for s in spans if s.symbol] == ["alpha", "Beta"]
    for line, name in (("pub async fn go<T>(x: T) {", "go"), ("func (s *Store) Get(id int) {", "Get"), ("export const load = async () => {", "load"), ("CREATE TABLE IF NOT EXISTS items (", "items"), ("x = 1", None), ("public partial class Shop {", "Shop"), ('pub extern "C" fn start() {', "start"), ("union Bits {", "Bits"), ("macro_rules! join {", "join"), ("const make = function (a) {", "make"), ("// class Old\n# def gone\ndef kept():", "kept"), ("export const f = async (a: number): Promise<void> => {", "f")):
        assert chunking.symbol_of(line) == name


def test_chunk_rows_have_byte_offsets(spark):
    rows = [(1, "prose", "é one. " * 200), (2, "data", None), (3, "markdown", "")]
    out = chunking.chunk(spark.createDataFrame(rows, "item_id long, kind string, text string")).collect()
    raw = rows[0][2].encode()
    assert out and all(r.item_id == 1 and raw[r.start : r.end].decode() == r.text and r.tokens <= 192 for r in out)
    assert [r.ordinal for r in sorted(out, key=lambda r: r.ordinal)] == list(range(len(out)))


def test_streams(spark, sf, tmp_path):
    uses = spark.createDataFrame([(i % 3, 1.0, 1_000_000 * i) for i in range(30)], "item_id long, weight double, at long")
    for k in range(3):
        uses.where(f"at % 3000000 = {k * 1_000_000}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(uses.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_usage.write_statistics(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r.item_id: (r.uses, round(r.rank_key, 9)) for r in stream_usage.read_statistics(spark, f"{tmp_path}/out").collect()}
    assert got == {r.item_id: (r.uses, round(r.rank_key, 9)) for r in usage.statistics(uses).collect()}
    query = stream_usage.running(stream).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.item_id: (r.uses, round(r.rank_key, 9)) for r in usage.folded(spark.table("sums")).collect()} == got


def test_change_stream(spark, tmp_path):
    rows = [("/a", "modify", False, False, "2024-01-01 00:00:00.000"), ("/a", "modify", True, True, "2024-01-01 00:00:00.100"), ("/b", "access", False, False, "2024-01-01 00:00:00.150"), (None, "modify", False, False, "2024-01-01 00:00:05"), ("/z", "create", False, False, "2024-01-01 00:10:00")]
    hints = spark.createDataFrame(rows, "path string, action string, recursive boolean, content boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.path, r.recursive, r.content, r.hints) for r in changes.coalesced(hints).orderBy("path").collect()] == [("/a", True, True, 2), ("/z", False, False, 1)]
    hints.coalesce(1).write.parquet(f"{tmp_path}/h")
    stream = spark.readStream.schema(hints.schema).parquet(f"{tmp_path}/h")
    changes.passes(stream, "1 second").writeStream.outputMode("append").format("memory").queryName("passes").trigger(availableNow=True).start().awaitTermination()
    done = [(r.hints, r.rescan) for r in spark.table("passes").orderBy("start").collect()]
    assert done == [(2, False), (1, True)]


def test_chunk_sizes_equal_counts_of_their_text():
    rng = random.Random(5)
    text = "".join(rng.choice(["word", "longerword ", " ", "\n", "\n\n", "é!", "漢字", "_", "1234567", ". "]) for _ in range(900))
    c = chunking.Chunker(text, chunking.Limits())
    for _ in range(600):
        a, b = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        assert c.size(a, b) == chunking.count_tokens(text[a:b])
