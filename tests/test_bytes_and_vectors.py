"""Decoding and the hashing embedder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import decode as D
from quarry.functions import embedding as E
from quarry.operators import contents, names, states
from quarry.plans import query as Q

CASES = [
    (b"\xef\xbb\xbfa\r\nb", ("a\nb", "utf-8", False)),
    ("é漢".encode("utf-16-le").join([b"\xff\xfe", b""]), ("é漢", "utf-16le", False)),
    ("x\ry".encode("utf-16-be").join([b"\xfe\xff", b""]), ("x\ny", "utf-16be", False)),
    ("añ".encode(), ("añ", "utf-8", False)),
    (b"a\xf1o \x80\x81", ("año €\x81", "windows-1252", False)),
    (b"a\x00b", (None, None, None)),
    (b"a" * 9000 + b"\x00", ("a" * 9000 + "\x00", "utf-8", False)),
    (b"\xef\xbb\xbf\xff", ("\ufffd", "utf-8", True)),
    (b"", ("", "utf-8", False)),
    (None, (None, None, None)),
]


def test_decode(spark):
    for raw, want in CASES:
        assert D.decode_bytes(raw) == want
    rows = spark.createDataFrame([(k, None if raw is None else bytearray(raw)) for k, (raw, _) in enumerate(CASES)], "k int, raw binary").select("k", D.decode("raw").alias("d")).collect()
    assert {r.k: tuple(r.d) for r in rows} == {k: want for k, (_, want) in enumerate(CASES)}


def test_fnv_and_embedding():
    assert E.fnv1a(b"") == 0xCBF29CE484222325 and E.fnv1a(b"a") == 0xAF63DC4C8601EC8C and E.fnv1a(b"foobar") == 0x85944171F73967E8
    a, b, c = E.embed_text("the red house"), E.embed_text("red house, the!"), E.embed_text("quarterly tax report")
    assert np.linalg.norm(a) == pytest.approx(1, abs=1e-6) and a @ b == pytest.approx(1, abs=1e-5) and a @ c < 0.5
    assert np.linalg.norm(E.embed_text("!!")) == pytest.approx(1)


def test_accented_words_are_found_by_names_and_contents(spark):
    words = ["Škoda", "łódź", "йод", "ﬁnance"]
    docs = contents.tokenized(spark.createDataFrame([(k, f"one {w} two") for k, w in enumerate(words)], "chunk_id long, text string"))
    batch = {"q0": "Škoda", "q1": "łódź", "q2": "йод", "q3": "finance", "q4": "skoda"}
    got = {(r.query_id, r.chunk_id) for r in contents.bm25(docs, Q.term_batch(spark, batch)).collect()}
    assert got == {("q0", 0), ("q1", 1), ("q2", 2), ("q3", 3), ("q4", 0)}
    items = spark.createDataFrame([(k, f"{w}.txt", f"/r/{w}.txt") for k, w in enumerate(words)], "id long, name string, path string")
    from quarry.functions import text as X

    items = items.select("id", F.lit("files").alias("source"), "name", X.fold_key(F.col("name")).alias("name_key"), "path", F.lit(None).cast("long").alias("modified"), F.lit(0).alias("attributes"))
    found = {(r.query_id, r.id) for r in names.search(items, Q.name_batch(spark, batch), 0).collect()}
    assert found == got


def test_skip_reasons_and_fingerprint(spark):
    rows = [("prose", 5, b"abc"), (None, 5, b"abc"), ("prose", 5 << 20, b"abc"), ("prose", 5, b"a\x00"), ("prose", 5, b"\xff\xfea\x00"), ("prose", 5, b"\x10\x0a")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, k string, s long, h binary").select("n", states.skip_reason(F.col("k"), F.col("s"), F.col("h")).alias("r"))
    assert [r.r for r in df.orderBy("n").collect()] == [None, "unsupported", "too_large", "binary", None, None]
    assert states.index_fingerprint(256) == "usearch-hnsw d256 cos f16 M16 efc128"
