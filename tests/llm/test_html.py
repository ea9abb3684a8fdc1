import html as stdlib
import random
import time

import pytest

from quire.llm import html
from tests.llm.helpers import DATA, have_data

CASES = [
    ("<p>a<p>b<br>c<br><br>d</p>e", "a\n\nb\nc\n\nd\n\ne"),
    ("<ul><li>one<li>two<ul><li>x</ul><li>three</ul>after", "- one\n- two\n  - x\n- three\n\nafter"),
    ("<ol start=3><li>q<li value=9>r<li>s</ol>", "3. q\n9. r\n10. s"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td rowspan=2>pear<td>10<tr><td>5</table>t", "Name   Qty\napple  3\npear   10\n       5\n\nt"),
    ("<table><td>x<td>y</table>", "x  y"),
    ("<table><tr><td>日本<td>1<tr><td>abcdef<td>2</table>", "日本    1\nabcdef  2"),
    ("<div style='display: none'>no</div>yes<span hidden>no</span>", "yes"),
    ("<span style='visibility:hidden'>no<b style='visibility:visible'>vis</b></span>", "vis"),
    ("<pre>a\n  b\n\nc</pre>z &amp; &nbsp;q < 3 <!-- c --> t", "a\n  b\n\nc\n\nz &  q < 3 t"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ('<head><title>t</title><style>p{}</style><script>var t="</p>";</script><body><h1>H</h1>x <b>bold</b>, y', "H\n\nx bold, y"),
    ("<dl><dt>T<dd>def<dt>U<dd>def2</dl>", "T\n    def\nU\n    def2"),
    ("<a href=\"x>y\">link</a> <a title='open>text</a> more", "link text more"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<script>never closed", ""),
    ("<!-- never closed", ""),
    ("<p", ""),
    ("a<", "a<"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "expected"), CASES)
def test_layout(page, expected):
    assert html.to_text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<head><title>t</title><body>Hello <b>x</b>", "Hello x"),
        ("<html><head><title>t</title><body>only text", "only text"),
        ("<head><title>t</title>no body tag &amp; text", "no body tag & text"),
        ("<head> <meta charset=x>\n<style>p{}</style> <link rel=x>\n</head><body>y", "y"),
        ("<head><template><body>no</template></head><body>yes", "yes"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> holds", "so x=1 holds"),
        ("<svg><title/><desc>no</desc><defs><text>no</text></defs>no" + "<path d='x'/>" * 600 + "<text>Label <tspan>one</tspan></text><text>two</text></svg>after", "Label one\ntwo\nafter"),
        ("<svg><foreignObject><p>in <b>html</b></p></foreignObject></svg>", "in html"),
        ("<p>a <svg/>b", "a b"),
        ("<svg><path><p>after an svg that never ends", "after an svg that never ends"),
        ("<mask>kept</mask> <annotation>kept</annotation>", "kept kept"),
    ],
)
def test_nothing_visible_is_lost(page, expected):
    assert html.to_text(page) == expected


def test_columns_are_aligned():
    lines = html.to_text("<table><tr><td colspan=2>w<td>z<tr><td>aaa<td>b<td>c</table>").split("\n")
    assert lines[0].index("z") == lines[1].index("c")


def test_words_of_plain_markup_survive():
    """Random nested blocks: every visible word comes out once, in order."""
    rng = random.Random(1)
    for _ in range(60):
        n, parts, words = 0, [], []
        for _ in range(rng.randrange(1, 60)):
            tag = rng.choice(["p", "div", "b", "li", "ul", "h2", "blockquote", "section", "td", "tr", "table", "i"])
            parts.append(rng.choice([f"<{tag}>", f"</{tag}>"]))
            word = f"w{n}&lt;x"
            n += 1
            parts.append(f" {word} ")
            words.append(stdlib.unescape(word))
        got = [w for w in html.to_text("".join(parts)).split() if w.startswith("w")]
        assert sorted(got) == sorted(words)


def test_hard_input_takes_linear_time():
    start = time.time()
    for page in ("<div>" * 60_000 + "x", '<b a="x ' * 30_000, "<table><tr><td>" * 2_000 + "y", "<p><table><tr><td>" + "<i>" * 30_000 + "</p>" * 30_000, "<" * 100_000, "&" * 100_000, "<li>" * 50_000):
        html.to_text(page)
    assert time.time() - start < 20


def test_operator(spark):
    pages = spark.createDataFrame([(1, "<p>x", "u"), (None, None, "u"), (1, "<p>x", "u"), (2, "", "u")], "page_id long, html string, text string")
    got = sorted((tuple(r) for r in html.op3_html_text(pages).collect()), key=str)
    assert got == sorted([(1, "x", 1), (1, "x", 1), (2, "", 0), (None, "", 0)], key=str)
    assert html.op3_html_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not have_data(), reason="no driver tables")
def test_pages_hold_their_article_and_no_script(spark):
    for r in html.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect():
        assert "track(" not in r.text and "margin:0" not in r.text and len(r.text) > 100


def test_wide_and_tall_cells_take_linear_time():
    """Spans that cover more rows and columns than there are."""
    took = []
    for n in (200, 400, 800):
        page = "<table>" + "<tr><td colspan=1000 rowspan=65534>a<td rowspan=3>b</tr>" * n + "</table>"
        start = time.monotonic()
        text = html.to_text(page)
        took.append(time.monotonic() - start)
        assert text.count("a") == text.count("b") == n
    assert took[2] < 3 * took[1] + 0.3, took


def test_rowspans_move_cells_aside():
    got = html.to_text("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>")
    assert got.split("\n") == ["a  b", "   c", "d  e"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<style>.h{display:none}</style><p class=h>x<p class='a h b'>y<p>z", "z"),
        ("<style>/* p{display:none} */ p.h , #k { color: red; display : NONE } div{visibility:hidden}</style><p class=h>a<p id=k>b<p>c<div class=h>d</div>", "c"),
        ("<style>@media print{p{display:none} i{display:none}} i{display:none}</style><p>a <i>b</i>", "a"),
        ("<style>p{display:none} .s{display:block}</style><p>a<p class=s>b<p style='display:block'>c", "b\n\nc"),
        ("<style>div{visibility:hidden} b{visibility:visible}</style><div>x <b>y</b></div>", "y"),
        ("<style>p{display:none", ""),
        ("<style>ul li{display:none} a:hover{display:none} {display:none}</style><p>a", "a"),
    ],
)
def test_style_sheets_hide(page, text):
    assert html.to_text(page) == text
