import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.plans import registry
from quire.sources import epub


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).collect()[0][0]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (fn.normalize_whitespace, "  hello   world  ", "hello world"),
        (fn.normalize_whitespace, "line\nbreak\ttab", "line break tab"),
        (fn.normalize_whitespace, "   ", ""),
        (fn.normalize_whitespace, None, ""),
        (fn.normalize_whitespace, "a\x1c b", "a b"),
        (fn.remove_hyphenation, "inter-  \n  national", "international"),
        (fn.remove_hyphenation, "word- word", "word- word"),
        (fn.remove_hyphenation, "so­ft", "soft"),
        (fn.resolve_ligatures, "ﬁ ﬄ æ Œ", "fi ffl ae OE"),
        (fn.strip_controls, "Clean\u0007This", "CleanThis"),
        (fn.comparison_form, "Excerpt F : Integral Post-Metaphysics and third-person", "Excerpt F: Integral Post Metaphysics and third person"),
        (fn.comparison_form, "see 12. end — first- and", "see 12 end - first and"),
        (fn.escape_html, "<a href=\"x\">&'", "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"),
        (fn.escape_html, None, ""),
        (fn.tokens, "Слово café ab c_d1 xyz", ["Слово", "café", "c_d1"]),
        (fn.word_count, " a  b\tc\n", 3),
        (fn.word_count, "", 0),
        (fn.snippet, "  a\nb ", "a b"),
        (fn.media_type, "JPEG", "image/jpeg"),
        (fn.media_type, "bmp", "image/png"),
    ],
)
def test_scalar_functions(spark, function, value, expected):
    assert one(spark, function, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("Thﬃs is a long-\nterm project æsthetic.", "Thffis is a longterm project aesthetic."), ("é", "é"), (None, ""), ("", ""), ("①", "1")],
)
def test_canonical_form(spark, value, expected):
    df = spark.createDataFrame([(1, value)], "doc_id long, t string")
    assert fn.canonicalize(df, "t").collect()[0].t == expected


def test_nfkc_is_that_of_the_standard_library(spark):
    values = ["ﬁ", "Ａ１", "½", "plain", "ế", "한글"]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", fn.nfkc(F.col("t")).alias("t")).orderBy("k").collect()
    assert [r.t for r in got] == [unicodedata.normalize("NFKC", v) for v in values]


def test_rename_extension(spark):
    df = spark.createDataFrame([("a.b.png", "jpeg"), ("x", "GIF")], "f string, e string")
    assert [r[0] for r in df.select(fn.rename_extension(F.col("f"), F.col("e"))).collect()] == ["a.b.jpg", "x.gif"]


def test_references_without_semicolon_stay_as_in_sql(spark):
    values = ["<title>a &amp;&amp; b&amp</title><p>&lt;&am</p>x &quot y &copyz; &amp;lt; & z&#39;", "&amp", "<p>1 &lt 2</p>&", "\ue000&ampb", ""]
    df = spark.createDataFrame(list(enumerate(values)), "page_id int, html string")
    got = {r.page_id: r.text for r in epub.with_text(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(values)))
    assert got == dict(con.execute(registry.oracle_sql()["html_text"]).fetchall())
    assert got[0] == "a && b&amp <&am x &quot y &copyz; &lt; & z'"
    assert epub.html_to_text("<p>&nbsp;&eacute;&#233;&#xe9;&notit;</p>") == "ééé&notit;"
