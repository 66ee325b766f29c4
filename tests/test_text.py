import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as X


def test_fold():
    assert X.fold_text("Reunión  Cliente.DOCX") == "reunion cliente.docx"
    assert X.fold_text("  Ñandú ") == "nandu"
    assert X.fold_text("ﬁn") == "fin"
    assert X.fold_text(None) is None


def test_tokens():
    assert X.tokens_text("myComponentName.tsx") == ["my", "component", "name", "tsx"]
    assert X.tokens_text("HTTPServer") == ["http", "server"]
    assert X.tokens_text("q3budget2025") == ["q", "3", "budget", "2025"]
    assert X.tokens_text("  --  ") == []


def test_jvm_tokens_equal_unicode_tokens_on_ascii(spark):
    names = ["myComponentName.tsx", "HTTPServer", "q3budget2025.xlsx", "A", "", "aB1Cd2", "X-ray_Plan v2", "XMLHttpRequest2", "__init__.py"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select("s", X.code_tokens(F.col("s")).alias("a"), X.tokens(F.col("s")).alias("b"), X.fold(F.col("s")).alias("f"))
    for r in df.collect():
        assert r.a == list(r.b), r.s
        assert r.f == X.fold_text(r.s)


def test_name_parts_and_paths(spark):
    df = spark.createDataFrame([("Visual Studio Code", "C:\\a\\b\\Big Folder\\docs\\x.md"), ("MyComponent.tsx", "/one/x"), ("notes", "notes")], "n string, p string")
    got = [(list(r.a), list(r.b), r.c) for r in df.select(X.name_parts(F.col("n")).alias("a"), X.path_tokens(F.col("p")).alias("b"), X.stem(F.col("n")).alias("c")).collect()]
    assert got[0] == (["visual", "studio", "code", "vsc"], ["b", "big", "folder", "docs"], "Visual Studio Code")
    assert got[1] == (["my", "component", "tsx", "mycomponent", "mc"], ["one"], "MyComponent")
    assert got[2] == (["notes"], [], "notes")


def _slow_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
def test_osa_equals_full_table(a, b, most):
    want = _slow_osa(a, b)
    assert X.osa(a, b, most) == (want if want <= most else None)


def test_osa_differs_from_other_distances():
    assert X.osa("ab", "ba", 2) == 1
    assert X.osa("ca", "abc", 3) == 3


def test_small_functions(spark):
    df = spark.createDataFrame([("a\r\nb\rc", ".JS", 5, None)], "t string, e string, n int, m long")
    r = df.select(X.newlines(F.col("t")).alias("t"), X.extension(F.col("e")).alias("e"), X.fingerprint(F.col("n"), F.col("m")).alias("f"), X.query_prompt(F.lit("x")).alias("q"), X.typo_budget(F.col("n")).alias("b"), X.extension(F.lit("a*b")).alias("bad")).first()
    assert (r.t, r.e, r.f, r.q, r.b, r.bad) == ("a\nb\nc", "js", "5:", "task: search result | query: x", 1, None)


def test_fold_of_columns_equals_fold_of_strings(spark):
    """Both sides of a search fold alike, in every script and for every character of the basic plane."""
    words = ["Škoda", "łódź", "йод Ёлка", "ﬁnance ½ №5", "ΟΔΟΣ οδος", "İstanbul ǅ", "Ａｂｃ ⅷ", "éä", "漢字 한글", "  a b c\td "]
    words += ["x" + "".join(chr(c) for c in range(k, k + 64) if c >= 32 and unicodedata.ucd_3_2_0.category(chr(c)) != "Cn") + "y" for k in range(0, 0xAC00, 64)]
    df = spark.createDataFrame([(w,) for w in words], "s string").select("s", X.fold_key(F.col("s")).alias("k"), X.search_terms(F.col("s")).alias("t"))
    rows = df.collect()
    for r in rows[:10]:
        assert r.k == X.fold_text(r.s), r.s
    wrong = [hex(ord(r.s[1])) for r in rows[10:] if r.k != X.fold_text(r.s)]
    assert not wrong  # of the characters that all Unicode versions know
    by = {r.s: r.t for r in rows[:10]}
    assert by["Škoda"] == ["skoda"] and by["łódź"] == ["łodz"] and by["йод Ёлка"] == ["иод", "елка"] and by["ﬁnance ½ №5"][0] == "finance"


def test_name_tokens_in_any_script(spark):
    names = ["ŠkodaOctavia2", "мойФайл.txt", "ÉTÉPlan", "łódźRoad", "éteNote"]
    df = spark.createDataFrame([(n,) for n in names], "s string").select("s", X.code_tokens(F.col("s")).alias("a"))
    for r in df.collect():
        assert r.a == X.tokens_text(r.s), r.s
