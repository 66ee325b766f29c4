from pyspark.sql import functions as F

from quarry.plans import query as Q
from quarry.plans.query import Filter, Term


def test_plain_text_is_untouched():
    q = Q.parse("  hello World ")
    assert (q.text, q.filters, q.phrases, q.valid) == ("  hello World ", [], [], True)


def test_filters_are_taken_out():
    q = Q.parse('TYPE:code ext:.RS in:"My Docs\\src/" before:2024-03-01 after:2024-02-28 main http://x ')
    assert q.valid and q.text == "main http://x "
    assert q.filters == [Filter("category", "code"), Filter("ext", "rs"), Filter("in", "my docs/src"), Filter("before", 1709251200000), Filter("after", 1709164800000)]


def test_malformed_filters_fail_closed():
    for text in ("type:", "type:spreadsheet", "ext:a-b", 'in:"x', "in:../a", "before:2023-02-29", "after:2024-2-9", "before:0000-01-01", " ".join(["ext:a"] * 17)):
        assert not Q.parse(text).valid, text
    assert Q.parse(" ".join(["ext:a"] * 16)).valid
    assert Q.parse("c:\\temp note:x").valid


def test_phrases():
    assert Q.parse('say "hello world" now').phrases == ["hello world"]
    assert Q.parse('open "hello').phrases == []


def test_kinds_without_content():
    assert not Q.parse("type:folder x").reads_content
    assert Q.parse("type:file x").reads_content


def test_terms():
    assert Q.terms("foo-bar's") == [Term(("foo",)), Term(("bar",)), Term(("s",))]
    assert Q.terms('a "b c" d"e') == [Term(("a",)), Term(("b", "c")), Term(("d",)), Term(("e",))]
    assert Q.terms("meeting retr", typing=True) == [Term(("meeting",)), Term(("retr",), True)]
    assert Q.terms("meeting re", typing=True) == [Term(("meeting",))]
    assert Q.terms("re", typing=True) == []
    assert Q.terms("retr ", typing=True) == [Term(("retr",))]
    assert Q.terms('x "y z"', typing=True) == [Term(("x",)), Term(("y", "z"))]


def test_content_and_pair_terms():
    assert Q.content_terms("notas de la reunión") == [Term(("notas",)), Term(("reunión",))]
    assert Q.content_terms("de la") == [Term(("de",)), Term(("la",))]
    assert Q.pair_terms("alpha beta") == []
    assert len(Q.pair_terms("a1 b1 c1 d1 e1 f1 g1")) == 6


def test_folder_filter(spark):
    df = spark.createDataFrame([("/a/B/c.txt", "file"), ("/a/b", "folder"), ("/a/bc/x", "file"), ("/x/a/b", "file"), ("C:\\a\\b\\f", "file"), (None, "file")], "p string, k string")
    hit = lambda folder: [r.x for r in df.select(F.coalesce(Q.inside(F.col("p"), folder, F.col("k")), F.lit(False)).alias("x")).collect()]
    assert hit("/a/b") == [True, True, False, False, False, False]
    assert hit("a/b") == [True, True, False, False, True, False]
    assert hit("b") == [True, True, False, False, True, False]
    assert hit("/") == [True, True, True, True, False, False]
