"""Block operators on hand-made blocks."""

import io
import random
import sys
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import images, links, noise, notes, order, render, structure, styles
from quire.operators.classify import classify
from quire.plans import cli, convert
from quire.sources import blocks as source
from quire.sources import config, epub, pdf
from quire.streaming import fidelity as stream

BODY = "The quick brown fox jumps over the lazy dog and then it sits down on the mat for a very long while, as foxes do, before it goes home again."


def made(spark, rows):
    """Blocks from (text, dict of other columns)."""
    out = []
    for k, (text, more) in enumerate(rows):
        d = {"page": 1, "x0": 50.0, "y0": 40.0 * k, "x1": 450.0, "y1": 40.0 * k + 12, "font": "Serif", "size": 12.0, "flags": 0} | more
        out.append((1, k, d["page"], d["x0"], d["y0"], d["x1"], d["y1"], d["font"], d["size"], d["flags"], text))
    return spark.createDataFrame(out, source.SCHEMA)


@pytest.mark.parametrize(
    ("text", "y0", "y1", "size", "expected"),
    [("27 SOME EVERYDAY EXAMPLES", 0, 40, 11, True), ("27 SOME EVERYDAY EXAMPLES", 200, 240, 11, False), ("94", 760, 790, 11, True), ("Part C: A Longer Title For All of This Together", 0, 40, 16, False), ("plain words here", 0, 40, 11, False)],
)
def test_header_footer(spark, text, y0, y1, size, expected):
    df = spark.createDataFrame([(text, float(y0), float(y1), float(size))], "t string, a double, b double, s double")
    test = noise.is_header_footer(F.col("t"), F.col("a"), F.col("b"), F.lit(800.0), F.col("s"), F.lit(11.0))
    unknown = noise.is_header_footer(F.col("t"), F.col("a"), F.col("b"), F.lit(800.0), F.col("s"), F.lit(None).cast("double"))
    row = df.select(test.alias("x"), unknown.alias("y")).collect()[0]
    assert row.x is expected and row.y is not None


def test_repeated_lines_go(spark):
    rows = [(f"Running title {p}" if k == 0 else f"Line {p} {k} of text {chr(97 + p)}", {"page": p}) for p in range(1, 7) for k in range(3)]
    blocks = made(spark, rows)
    found = noise.repeated_lines(blocks)
    assert ("Running title #", 6) in {(r.pattern, r.n_pages) for r in found.collect()}
    left = noise.strip_repeated(blocks, found.where("pattern = 'Running title #'")).collect()
    assert [r.text for r in left if r.seq % 3 == 0] == [""] * 6 and all(r.text for r in left if r.seq % 3)
    assert noise.repeated_lines(blocks.where("page = 1")).count() == 0


def test_side_blocks(spark):
    blocks = made(spark, [("Main1", {"x0": 50.0, "y0": 0.0, "x1": 450.0, "y1": 20.0}), ("Side", {"x0": 480.0, "y0": 10.0, "x1": 520.0, "y1": 25.0}), ("Main2", {"x0": 50.0, "y0": 40.0, "x1": 450.0, "y1": 60.0})])
    assert [r.text for r in order.side_blocks_last(blocks).orderBy("seq").collect()] == ["Main1", "Main2", "Side"]


def test_xy_cut_reads_columns(spark):
    rows = []
    for name, x in (("L", 0.0), ("R", 300.0)):
        rows += [(f"{name}{k}", {"x0": x, "x1": x + 200, "y0": 20.0 * k, "y1": 20.0 * k + 25}) for k in range(4)]
    rows.append(("Top", {"x0": 0.0, "x1": 500.0, "y0": -50.0, "y1": -20.0}))
    got = [r.text for r in order.xy_cut(made(spark, rows)).orderBy("seq").collect()]
    assert got == ["Top", "L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3"]
    assert [r.text for r in order.y_sort(made(spark, rows)).orderBy("seq").limit(3).collect()] == ["Top", "L0", "R0"]


def test_style_roles(spark):
    sizes = [26.0 - 1.5 * k for k in range(8)]
    rows = [(BODY, {}), *[(f"Heading {k}", {"size": s, "font": f"F{k}"}) for k, s in enumerate(sizes)], ("bold", {"flags": 16}), ("tiny", {"size": 8.0})]
    got = {r["size"]: r.style_role for r in styles.roles(made(spark, rows)).where("flags = 0").collect()}
    assert (got[26.0], got[24.5], got[15.5], got[12.0], got[8.0]) == ("h1", "h2", "h6", "body", "footnote_or_small")
    near = styles.histogram(made(spark, [("a", {"size": 11.99}), ("b", {"size": 12.01})]))
    assert [(r["size"], r.n_chars) for r in near.collect()] == [(12.0, 2)]


@pytest.mark.parametrize("n", range(30))
def test_sample_pages(spark, n):
    got = styles.sample_pages(n)
    assert len(got) == min(n, 5) and len(set(got)) == len(got)
    assert n < 10 or got == sorted({0, 3, 4, n // 2, n - 1})


def test_classification(spark):
    rows = [
        (BODY, {}), ("Chapter One", {"size": 18.0, "flags": 16}), (BODY, {}), ("• First item of it all, with some more words so that it is no heading, and it has a comma, and an end.", {}),
        ("1. Third item of it all, with some more words so that it is no heading, and it has a comma, and an end too, with much more of it to be long enough, yes.", {}),
        ("12  More technically, a note goes on like this, for long enough that it could hardly be a heading, with commas, and an end mark at the very end of it all.", {"size": 10.0}),
    ]
    got = [(r.role, r.endnote_num) for r in classify(made(spark, rows)).orderBy("seq").collect()]
    assert got == [("body", None), ("h1", None), ("body", None), ("list-item", None), ("list-item", None), ("endnote", 12)]


def roled(spark, rows):
    blocks = made(spark, [(t, {}) for t, *_ in rows])
    parts = spark.createDataFrame([(k, r[1], r[2] if len(r) > 2 else None) for k, r in enumerate(rows)], "seq int, role string, endnote_num int")
    return blocks.join(parts, "seq").select(*blocks.columns, "role", "endnote_num")


def test_notes_chapter(spark):
    rows = [("Title", "h1"), ("Body text here.", "body"), ("ENDNOTES to Excerpt C", "body"), ("1  First note", "endnote", 1), ("goes on", "body"), ("2  Second", "endnote", 2)]
    blocks = roled(spark, rows)
    chapters = {r.title: r for r in structure.chapters(blocks).collect()}
    assert chapters["ENDNOTES to Excerpt C"].is_endnotes and chapters["ENDNOTES to Excerpt C"].n_blocks == 2 and set(chapters) == {"Title", "ENDNOTES to Excerpt C"}
    merged = structure.merge_notes(structure.split_notes(blocks).where("part = 'notes'")).orderBy("seq").collect()
    assert [(r.endnote_num, r.text) for r in merged] == [(1, "1  First note goes on"), (2, "2  Second")]
    assert structure.chapter_text(blocks).collect()[0].text == "Title\n\nBody text here.\n\n1  First note goes on\n\n2  Second"


def test_chapter_tree_against_a_stack(spark):
    rng = random.Random(1)
    for _ in range(4):
        rows = [(f"T{k}", rng.choice(["h1", "h2", "h3", "h4", "body"])) for k in range(30)]
        got = {r.chapter_id: r.parent_id for r in structure.assign_chapters(roled(spark, rows)).collect()}
        stack, n, want = [(0, 0)], 0, {}
        if rows[0][1] == "body":
            want[0] = None
        for _, role in rows:
            if role == "body":
                continue
            n += 1
            level = int(role[1:])
            if level == 1:
                stack = []
            while stack and stack[-1][1] >= level:
                stack.pop()
            want[n] = stack[-1][0] if stack else None
            stack.append((n, level))
        assert got == want


def test_inferred_note_pages(spark):
    rows = [(f"x{p}", {"page": p}) for p in range(1, 31)]
    blocks = made(spark, rows).withColumns({"role": F.lit("body"), "endnote_num": F.when(F.col("page").isin(5, 14, 18, 22, 28, 29), F.col("page"))})
    assert [(r.first_page, r.last_page) for r in structure.note_pages(blocks).collect()] == [(14, 30)]
    assert structure.note_pages(blocks.where("page > 20")).count() == 0


@pytest.mark.parametrize(
    ("text", "names", "expected"),
    [
        ("This is a statement[1] with reference[12].", ("bracket",), [(1, "[1]"), (12, "[12]")]),
        ("This statement.1 has a reference.12 here.", ("period",), [(1, ".1"), (12, ".12")]),
        ("This is a sentence. 5   Next sentence", ("spaced",), [(5, "5")]),
        ("Notice this.\n 1   First list item.", ("spaced",), []),
        ("a transformation 20 ]....", ("spaced_closer",), [(20, "20")]),
        ("See endnotes 2 and 8 for more details.", ("keyword",), [(2, "2")]),
        ("With 20/20 hindsight", ("spaced",), []),
        ("Figure 2.  8 Major", ("spaced",), []),
        ("Reference[100] and [999]", ("bracket",), []),
        (None, notes.DEFAULT, []),
        ("see (3) and [3]", ("paren", "bracket", "unknown"), [(3, "(3)"), (3, "[3]")]),
    ],
)
def test_note_references(spark, text, names, expected):
    row = notes.references(spark.createDataFrame([(text,)], "text string"), names=names).collect()[0]
    assert [(r.num, r.text) for r in row.refs] == expected
    assert all(text[r.start : r.end] == r.text for r in row.refs)


def test_note_links_and_html(spark):
    df = spark.createDataFrame([(1, "a[1] b[2].", "n.xhtml"), (2, "a[1]", None)], "k int, t string, f string")
    got = {r.k: r.t for r in notes.link(df, "t", F.col("f")).collect()}
    assert got[1] == 'a<a href="n.xhtml#note1" class="footnote-ref"><sup>1</sup></a> b<a href="n.xhtml#note2" class="footnote-ref"><sup>2</sup></a>.' and got[2] == "a[1]"
    rows = spark.createDataFrame([(1, 0, 3, "3  Some <text>"), (1, 1, None, "no number"), (1, 2, None, "7. seven")], "doc_id long, seq int, endnote_num int, text string")
    lines = notes.notes_html(rows).collect()[0].html.split("\n")
    assert lines[0] == '    <p class="endnote" id="note3"><span class="endnote-num">3.</span> Some &lt;text&gt;</p>'
    assert lines[1] == '    <p class="endnote">no number</p>' and 'id="note7"' in lines[2]
    assert '#ref3" class="endnote-backlink"' in notes.notes_html(rows, "chapter1.xhtml").collect()[0].html
    assert list(notes.note_numbers(rows).collect()[0].numbers) == [3]


def test_link_statistics(spark):
    rows = [(1, 1, '<a href="c2.xhtml#note1">x</a><a href="c2.xhtml#note2">x</a><a href="#note9">y</a>'), (1, 2, '<p class="endnote" id="note1"/><p class="endnote" id="note2"/><p class="endnote" id="note3"/>')]
    got = notes.link_stats(spark.createDataFrame(rows, "doc_id long, chapter_no int, html string")).collect()[0]
    assert (got.n_notes, got.n_links, got.n_linked, got.n_missing) == (3, 2, 2, 1)


def test_figures(spark):
    pictures = spark.createDataFrame([(1, 1, 1, 5.0, 0.0), (1, 2, 2, None, None)], "doc_id long, image_no int, page int, y0 double, x0 double")
    numbered = order.number_images(pictures).withColumn("root_no", F.col("image_seq"))
    rows = spark.createDataFrame([(1, "see Figure 1, fig. 2 and Fig 9; рис. 2", 1), (2, "Fig. 1", 1)], "doc_id long, text string, root_no int")
    got = {r.doc_id: r.text for r in links.link_figures(rows, numbered).collect()}
    assert got[1] == 'see <a href="#img-1" class="figure-ref">Figure 1</a>, <a href="chapter2.xhtml#img-2" class="figure-ref">fig. 2</a> and Fig 9; <a href="chapter2.xhtml#img-2" class="figure-ref">рис. 2</a>'
    assert got[2] == "Fig. 1"
    size = spark.range(1).select(images.fitted(F.lit(2400), F.lit(100)).alias("a"), images.fitted(F.lit(10), F.lit(10)).alias("b")).collect()[0]
    assert tuple(size.a) == (1200, 50) and tuple(size.b) == (10, 10)


def test_contained_in_blocks_of_items(spark):
    items = spark.createDataFrame([(1, "lazy dog"), (2, "nowhere at all"), (3, "quick"), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, BODY), (2, "none"), (3, None)], "doc_id long, text string")
    for size in (8 << 20, 5):
        assert sorted(tuple(r) for r in links.contained(items, docs, block_bytes=size).collect()) == [(1, 1), (3, 1)]


def test_rendering_and_books(spark):
    rows = [("Part I", "h1"), ("First paragraph ends here.", "body"), ("A see [1] & more", "body"), ("Sub", "h2"), ("Below it.", "body"), ("ENDNOTES", "body"), ("1  The note", "endnote", 1)]
    blocks = roled(spark, rows)
    pictures = spark.createDataFrame([(1, 1, 1, 100.0, 0.0, "png")], "doc_id long, image_no int, page int, y0 double, x0 double, format string")
    out = render.render_chapters(blocks, order.number_images(images.name_images(pictures))).orderBy("chapter_no").collect()
    assert [(r.title, r.level, r.is_endnotes) for r in out] == [("Part I", 1, False), ("ENDNOTES", 1, True)]
    main = out[0].html
    assert "<h2>Sub</h2>" in main and '<a href="chapter2.xhtml#note1" class="footnote-ref"><sup>1</sup></a> &amp; more</p>' in main and '<figure class="chapter-image" id="img-1">' in main
    assert "Part I" not in main and 'id="note1"' in out[1].html
    data = epub.write_book({"title": "A & B", "author": "C"}, [{"title": r.title, "html": r.html, "is_endnotes": r.is_endnotes} for r in out])
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        first = book.infolist()[0]
        assert first.filename == "mimetype" and first.compress_type == zipfile.ZIP_STORED
        assert 'epub:type="endnotes"' in book.read("book/chapter2.xhtml").decode() and "A &amp; B" in book.read("book/package.opf").decode()
    title, creator, chapters = epub.read_book(data)
    assert (title, creator, len(chapters)) == ("A & B", "C", 2)
    assert data == epub.write_book({"title": "A & B", "author": "C"}, [{"title": r.title, "html": r.html, "is_endnotes": r.is_endnotes} for r in out])


def test_epub_files(spark, tmp_path):
    chapters = [{"title": "One", "html": "<p>first ﬁle</p><script>x</script>"}, {"title": "Two", "html": "<p>second</p>"}]
    (tmp_path / "a.epub").write_bytes(epub.write_book({"title": "T", "author": "A"}, chapters))
    (tmp_path / "b.epub").write_bytes(b"no book")
    rows = epub.read_epub(spark, str(tmp_path))
    assert rows.where("error is not null").count() == 1 and rows.where("error is null").count() == 2
    assert epub.full_text(rows).collect()[0].text == "One One first file\n\nTwo Two second"


def test_config():
    made = config.from_dict({"reading_order_strategy": "xy_cut", "description": "x", "heading_detection": {"max_heading_levels": 3}, "metadata": {"title": "T"}}, {"metadata": {"author": "A"}})
    assert (made.reading_order_strategy, made.metadata.title, made.metadata.author, made.metadata.language) == ("xy_cut", "T", "A", "en")
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    with pytest.raises(ValueError):
        config.from_dict({"reading_order_strategy": "nothing"})


def test_metadata_precedence(spark):
    docs = spark.createDataFrame([(1, "Own", "", "P", "S")], "doc_id long, title string, author string, producer string, subject string")
    row = convert.metadata(docs, config.from_dict({"metadata": {"language": "de"}})).collect()[0]
    assert tuple(row)[1:] == ("Own", "Unknown", "de", "P", "S", None)


def test_blocks_from_spans(spark):
    head = (1, 1, 800.0, 0, 0)
    rows = [(*head, 0, 0, 0.0, 0.0, 9.0, 9.0, 0.0, 9.0, "A", 12.0, 0, "Long text"), (*head, 0, 1, 0.0, 0.0, 9.0, 9.0, 0.0, 9.0, "B", 14.0, 16, "x"), (*head, 1, 0, 0.0, 0.0, 9.0, 9.0, 0.0, 9.0, "B", 14.0, 16, "  "), (1, 1, 800.0, 1, 1, 0, 0, 0.0, 0.0, 9.0, 9.0, 0.0, 9.0, "I", 1.0, 0, "image")]
    got = source.blocks_from_spans(spark.createDataFrame(rows, source.SPANS)).collect()
    assert [(r.text, r.font_name, r.font_size, r.flags) for r in got] == [("Long text x ", "A", 12.0, 0)]
    assert source.page_text(source.lines_from_spans(spark.createDataFrame(rows, source.SPANS))).collect()[0].text == "Long textx"


WORDS = ["", "Alpha", "Beta", "Gamma", "Delta", "Epsilon"]


def test_scan_leaves_page_noise_out(spark):
    rows = []

    def line(block, text, y):
        rows.append((1, p, 800.0, block, 0, 0, 0, 50.0, y, 400.0, y + 12, y, y + 12, "A", 11.0, 0, text))

    for p in range(1, 6):
        line(0, f"RUNNING TITLE {p}", 20.0)
        line(1, f"{WORDS[p]} begins ﬁnely, with The Journal of Foxes vol {p} and goes on", 200.0)
        line(2, f"The Journal of Foxes vol {p}", 300.0)
        line(3, str(p), 780.0)
    spans = spark.createDataFrame(rows, source.SPANS)
    want = [f"{WORDS[p]} begins finely, with  and goes on" for p in range(1, 6)]
    assert [r.text for r in convert.scan_blocks(spans).orderBy("seq").collect()] == want
    assert [r.text for r in convert.scan_pages(spans).orderBy("page").collect()] == want
    assert convert.full_text(spans).collect()[0].text == "\n\n".join(want)


def test_pdf_needs_its_library(spark):
    if not pdf.available():
        with pytest.raises(RuntimeError):
            pdf.read_pdf(spark, "/nowhere")
        with pytest.raises(RuntimeError):
            pdf.read_pdf_images(spark, "/nowhere")


class _Page:
    """A page as the PDF library has it."""

    rect = type("Rect", (), {"height": 700.0})

    def __init__(self, image):
        self.image = image

    def get_text(self, kind):
        assert kind == "dict"
        span = {"bbox": (1.0, 2.0, 3.0, 4.0), "font": "A", "size": 11.04, "flags": 16, "text": "word"}
        blocks = [{"type": 0, "bbox": (1.0, 2.0, 3.0, 4.0), "lines": [{"bbox": (1.0, 2.0, 3.0, 4.0), "spans": [span, span]}]}]
        return {"blocks": blocks + ([{"type": 1, "bbox": (0.0, 0.0, 9.0, 9.0), "width": 9, "height": 9, "ext": "png", "image": b"x"}] if self.image else [])}

    def get_images(self, full):
        return [(7,)] if full else []


class _Document:
    is_encrypted, page_count, metadata = False, 2, {"title": "T", "author": "", "creationDate": "D:2020"}

    def __init__(self, data):
        if data == b"broken":
            raise ValueError("no document")
        self.is_encrypted = data == b"locked"

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def __iter__(self):
        return iter([_Page(True), _Page(False)])

    def extract_image(self, number):
        return {"width": 4, "height": 5, "ext": "jpeg", "image": b"y"}


def test_pdf_rows_with_a_stand_in_library(monkeypatch):
    """The readers' loops over what the library delivers, and rows for broken and locked files."""
    monkeypatch.setitem(sys.modules, "fitz", type("fitz", (), {"open": staticmethod(lambda stream, filetype: _Document(stream))}))
    files = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "content": [b"good", b"broken", b"locked"]})
    rows = [r for batch in pdf._spans(iter([files])) for r in batch.to_pylist()]
    good = [r for r in rows if r["path"] == "a"]
    assert [(r["page"], r["block_no"], r["span_no"], r["font_size"], r["text"]) for r in good] == [(p, 0, s, 11.0, "word") for p in (1, 2) for s in (0, 1) for _ in (0,)]
    assert [r["error"] for r in rows if r["path"] != "a"] == ["ValueError: no document", "RuntimeError: the file is encrypted"]
    pictures = [r for batch in pdf._images(iter([files])) for r in batch.to_pylist()]
    assert [(r["page"], r["image_no"], r["x1"], r["format"], r["data"]) for r in pictures] == [(1, 1, 9.0, "png", b"x"), (2, 1, None, "jpeg", b"y")]
    heads = [r for batch in pdf._documents(iter([files])) for r in batch.to_pylist()]
    assert [(r["path"], r["page_count"], r["title"], r["author"], r["created"]) for r in heads] == [("a", 2, "T", None, "D:2020"), ("b", None, None, None, None), ("c", None, None, None, None)]


def test_settings_act(spark):
    rows = [("Left one", {"x0": 0.0, "x1": 200.0, "y0": 100.0, "y1": 130.0}), ("Right one", {"x0": 300.0, "x1": 500.0, "y0": 110.0, "y1": 140.0}), ("Left two", {"x0": 0.0, "x1": 200.0, "y0": 131.0, "y1": 160.0}), ("Top", {"y0": 5.0, "y1": 12.0})]
    blocks = made(spark, rows)
    cut = convert.prepared(blocks, config.from_dict({"multi_column": {"enabled": True, "column_count": 2}}))
    assert [r.text for r in cut.orderBy("seq").collect()] == ["Top", "Left one", "Left two", "Right one"]
    with pytest.raises(ValueError):
        convert.prepared(blocks, config.from_dict({"exclude_regions": {"top": 0.1}}))
    edges = config.from_dict({"exclude_regions": {"top": 0.1, "right": 0.5}})
    sized = blocks.withColumns({"page_height": F.lit(700.0), "page_width": F.lit(500.0)})
    assert {r.text for r in convert.prepared(sized, edges).collect()} == {"Left one", "Left two"}
    large = made(spark, [(BODY, {}), ("A larger line that ends here.", {"size": 13.0, "y1": 52.0})])
    roles = [{r.text: r.role for r in classify(large, x).collect()}["A larger line that ends here."] for x in (1.2, 1.05)]
    assert roles == ["body", "h1"]
    with pytest.raises(ValueError):
        config.from_dict({"heading_detection": {"font_size_threshold": 0}})
    noted = made(spark, [("Chapter 1", {"size": 18.0, "flags": 16}), ("A claim [1] is here and goes on for quite a while, as claims do.", {}), (BODY, {}), ("ENDNOTES", {}), ("1  The note", {})])
    for on, back in ((True, False), (True, True), (False, False)):
        html = "".join(r.html for r in convert.convert(noted, config.from_dict({"footnote_processing": {"enabled": on, "generate_backlinks": back}})).collect())
        assert ("footnote-ref" in html, "endnote-backlink" in html) == (on, back)


def test_verdict_needs_all_images(spark):
    from quire.plans import validate

    texts = spark.createDataFrame([(1, BODY), (2, BODY)], "doc_id long, text string")
    chapters = spark.createDataFrame([(1, 0, None, False, 1), (2, 0, None, False, 1)], "doc_id long, chapter_id int, parent_id int, is_endnotes boolean, n_blocks long")
    nothing = spark.createDataFrame([], "doc_id long, n_notes long, n_links long, n_linked long, n_missing long")
    found, kept = (spark.createDataFrame([(1, 2), (2, n)], "doc_id long, n int") for n in (2, 1))
    reports = {r.doc_id: r.report for r in validate.summary_text(validate.conversion_stats(texts, texts, chapters, nothing, found, kept)).collect()}
    assert reports[1].endswith("PASS") and "Images: 1 of 2" in reports[2] and reports[2].endswith("NEEDS REVIEW")


def test_command_line(spark, tmp_path):
    texts = spark.createDataFrame([(1, "some words " * 100)], "doc_id long, text string")
    texts.write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1, "other things")], "doc_id long, text string").write.parquet(str(tmp_path / "b"))
    source.derive(texts).write.parquet(str(tmp_path / "blocks"))
    assert cli.main(["validate", str(tmp_path / "a"), str(tmp_path / "a"), "-o", str(tmp_path / "same")]) == 0
    assert cli.main(["validate", str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "other")]) == 1
    assert cli.main(["analyze", str(tmp_path / "blocks")]) == 0


def test_command_line_writes_books(spark, tmp_path, capsys):
    texts = spark.createDataFrame([(k, f"Title {k}\n" + BODY) for k in (1, 2)], "doc_id long, text string")
    source.derive(texts).write.parquet(str(tmp_path / "blocks"))
    assert cli.main(["convert", str(tmp_path / "blocks"), "-o", str(tmp_path / "books")]) == 0
    assert "Document 1\nWords:" in capsys.readouterr().out
    title, _, chapters = epub.read_book((tmp_path / "books" / "2.epub").read_bytes())
    assert title == "Unknown" and any("lazy dog" in html for _, html in chapters)
    assert cli.main(["validate", str(tmp_path / "books"), str(tmp_path / "books")]) == 0
    assert sorted(r.text[:7] for r in cli._texts(spark, str(tmp_path / "books")).collect()) == ["Title 1", "Title 2"]
    source.derive(texts.where("doc_id = 1")).write.parquet(str(tmp_path / "one"))
    assert cli.main(["convert", str(tmp_path / "one"), "--no-report", "-o", str(tmp_path / "one.epub")]) == 0
    assert cli.main(["validate", str(tmp_path / "one.epub"), str(tmp_path / "one.epub")]) == 0
    with pytest.raises(SystemExit):
        cli.main(["convert", str(tmp_path / "blocks"), "--no-report", "-o", str(tmp_path / "two.epub")])


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [(k, f"some text number {k} " * 60, f"some text number {k} " * (60 - k)) for k in range(5)]
    pairs = spark.createDataFrame(rows, "doc_id long, source string, target string")
    pairs.write.parquet(str(tmp_path / "in"))
    query = stream.write_scores(stream.read_pairs(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    from quire.operators import fidelity

    want = fidelity.scores(pairs)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_keep_pages_and_regions(spark):
    blocks = made(spark, [(str(p), {"page": p, "y0": 100.0 * p, "y1": 100.0 * p + 10}) for p in range(1, 6)])
    assert [r.page for r in noise.keep_pages(blocks, 2, -2, (3,)).orderBy("page").collect()] == [2, 4]
    assert [r.page for r in noise.drop_regions(blocks, F.lit(500.0), 0.3, 0.9).orderBy("page").collect()] == [2, 3, 4]
