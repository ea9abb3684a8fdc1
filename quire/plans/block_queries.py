"""Queries on derived block tables: noise, order, styles, roles, structure, notes, links, books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import classify as roles
from quire.operators import images, links, noise, notes, order, render, structure, styles
from quire.plans import convert, validate
from quire.plans.text_queries import _COMPLETE, CANONICAL, TAGLESS, table
from quire.runtime import checkpointed
from quire.sources import blocks as source
from quire.sources import epub
from quire.sources.blocks import PAGE_HEIGHT, derive_sql

def _ref():
    """A note reference to put behind each derived line."""
    return F.concat(F.lit(" ["), F.col("i") % 99 + 1, F.lit("]"))


_REF_SQL = "' [' || (i % 99 + 1) || ']'"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _blocks(spark: SparkSession, sf_dir: str, mark=None) -> DataFrame:
    return source.derive(_docs(spark, sf_dir), mark)


def _varied_lines(lines):
    """Lines with what the tables lack: page numbers and running heads, part headings, list items."""

    def one(x, i):
        page = F.floor(i / 20) + 1
        head = F.when(i % 60 == 59, page.cast("string")).when(i % 20 == 19, F.concat(F.lit("PAGE HEAD "), page)).when(i % 40 == 20, F.concat(F.lit("Chapter IV "), x))
        return head.when(i % 13 == 5, F.concat(F.lit("• "), x)).when(i % 13 == 6, F.concat(F.lit("- "), x)).when(i % 13 == 7, F.concat(F.lit("3. "), x)).otherwise(x)

    return F.transform(lines, one)


_VARIED = """list_transform(string_split(text, chr(10)), lambda x, k: CASE WHEN k % 60 = 0 THEN ((k - 1) // 20 + 1)::VARCHAR WHEN k % 20 = 0 THEN 'PAGE HEAD ' || ((k - 1) // 20 + 1) WHEN k % 40 = 21 THEN 'Chapter IV ' || x
    WHEN k % 13 = 6 THEN '• ' || x WHEN k % 13 = 7 THEN '- ' || x WHEN k % 13 = 8 THEN '3. ' || x ELSE x END)"""
_VARIED_SQL = f"documents AS (SELECT doc_id, array_to_string({_VARIED}, chr(10)) AS text FROM main.documents)"


def _varied(spark: SparkSession, sf_dir: str, mark=None) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", _varied_lines(F.split("text", "\n")).alias("lines"))
    return source.derive(rows.select("doc_id", F.array_join("lines", "\n").alias("text")), mark)


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Varied blocks whose document ends with a page of notes in documents of more than two lines."""
    n = F.size("lines")
    tail = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.when(k % 3 == 0, F.lit("goes on here")).otherwise(F.concat(k, F.lit("  note on "), F.lit("line "), k)))
    lines = F.concat(F.col("lines"), F.array(F.lit("ENDNOTES to the text")), tail)
    rows = _docs(spark, sf_dir).select("doc_id", _varied_lines(F.split("text", "\n")).alias("lines"))
    return source.derive(rows.select("doc_id", F.array_join(F.when(n > 2, lines).otherwise(F.col("lines")), "\n").alias("text")))


_NOTED_SQL = f"""documents AS (
  SELECT doc_id, CASE WHEN len(lines) > 2 THEN array_to_string(lines, chr(10)) || chr(10) || 'ENDNOTES to the text' || chr(10) || '1  note on line 1' || chr(10) || '2  note on line 2'
    || chr(10) || 'goes on here' || chr(10) || '4  note on line 4' || chr(10) || '5  note on line 5' || chr(10) || 'goes on here' ELSE array_to_string(lines, chr(10)) END AS text
  FROM (SELECT doc_id, {_VARIED} AS lines FROM main.documents))"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three images on the pages of every document."""
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("image_no"))
    return rows.select(
        "doc_id", "image_no", (F.col("image_no") % 2 + 1).cast("int").alias("page"), (F.col("image_no") * 100.0).alias("y0"), F.lit(60.0).alias("x0"),
        F.element_at(F.array(F.lit("png"), F.lit("JPEG"), F.lit("bmp")), F.col("image_no")).alias("format"),
    )


def derived_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


def _spans(spark, sf_dir):
    """Two spans to a block, of which the first word is bold."""
    rows = _varied(spark, sf_dir)
    first = F.regexp_extract("text", r"^\S*", 0)
    parts = F.array(F.struct(F.lit(0).alias("no"), first.alias("t"), F.lit(16).alias("f")), F.struct(F.lit(1).alias("no"), F.substring(F.col("text"), F.length(first) + 1, F.length("text")).alias("t"), F.lit(0).alias("f")))
    rows = rows.withColumn("s", F.explode(parts))
    return rows.select(
        "doc_id", "page", F.lit(PAGE_HEIGHT).alias("page_height"), F.col("seq").alias("block_no"), F.lit(0).alias("block_type"), F.lit(0).alias("line_no"), F.col("s.no").alias("span_no"),
        "x0", "y0", "x1", "y1", F.col("y0").alias("line_y0"), F.col("y1").alias("line_y1"), "font_name", "font_size", F.col("s.f").alias("flags"), F.col("s.t").alias("text"),
    )


def structural_blocks(spark, sf_dir):
    return source.blocks_from_spans(_spans(spark, sf_dir))


def page_text(spark, sf_dir):
    return convert.scan_pages(_spans(spark, sf_dir))


def scan_blocks(spark, sf_dir):
    return convert.scan_blocks(_spans(spark, sf_dir))


def scanned_text(spark, sf_dir):
    return convert.full_text(_spans(spark, sf_dir))


def noise_lines(spark, sf_dir):
    return noise.repeated_lines(_varied(spark, sf_dir))


def noise_strip(spark, sf_dir):
    rows = _varied(spark, sf_dir)
    return noise.strip_repeated(rows, noise.repeated_lines(rows)).select("doc_id", "seq", "text")


def header_footer(spark, sf_dir):
    rows = _varied(spark, sf_dir)
    rows = rows.join(noise.body_size(rows), "doc_id", "left")
    edge = noise.is_header_footer(F.col("text"), F.col("y0"), F.col("y1"), F.lit(PAGE_HEIGHT), F.col("font_size"), F.col("body_size"))
    return rows.select("doc_id", "seq", "body_size", edge.alias("is_edge"))


def page_filters(spark, sf_dir):
    rows = noise.keep_pages(_blocks(spark, sf_dir), 1, -1, (2,))
    return noise.drop_regions(rows, F.lit(PAGE_HEIGHT), 0.05, 0.95).select("doc_id", "seq", "page")


def y_sort(spark, sf_dir):
    rows = _blocks(spark, sf_dir).withColumn("was", F.col("seq")).withColumn("y0", F.lit(700.0) - F.col("y0"))
    return order.y_sort(rows).select("doc_id", "was", "seq")


def xy_cut(spark, sf_dir):
    """Pages of two columns that overlap in height, by turns."""
    right, row = F.col("seq") % 2, F.floor(F.col("seq") % 20 / 2)
    y0 = row * 40.0 + right * 20.0
    boxes = {"font_size": F.col("seq").cast("double"), "x0": 50.0 + right * 300.0, "x1": 250.0 + right * 300.0, "y0": y0, "y1": y0 + 36.0}
    return order.xy_cut(_blocks(spark, sf_dir).withColumns(boxes)).select("doc_id", F.col("font_size").cast("int").alias("was"), "seq")


def side_blocks(spark, sf_dir):
    rows = _blocks(spark, sf_dir).withColumn("was", F.col("seq"))
    narrow = F.col("seq") % 5 == 3
    rows = rows.withColumn("x0", F.when(narrow, 800.0).otherwise(F.col("x0"))).withColumn("x1", F.when(narrow, 860.0).otherwise(F.col("x1")))
    return order.side_blocks_last(rows).select("doc_id", "was", "seq")


def style_histogram(spark, sf_dir):
    return styles.histogram(_blocks(spark, sf_dir))


def body_style(spark, sf_dir):
    return styles.body_style(_blocks(spark, sf_dir))


def style_roles(spark, sf_dir):
    return styles.roles(_blocks(spark, sf_dir))


def layout_profile(spark, sf_dir):
    return styles.profile(_blocks(spark, sf_dir))


def heading_score(spark, sf_dir):
    return roles.heading_scores(_blocks(spark, sf_dir)).select("doc_id", "seq", "score", F.array_join("signals", ",").alias("signals"))


def block_roles(spark, sf_dir):
    return roles.classify(_noted(spark, sf_dir)).select("doc_id", "seq", "role", F.coalesce("endnote_num", F.lit(0)).alias("endnote_num"))


def merge_headers(spark, sf_dir):
    return structure.merge_headers(roles.classify(_blocks(spark, sf_dir))).select("doc_id", "seq", "role", "text")


def paragraphs(spark, sf_dir):
    return structure.paragraphs(_blocks(spark, sf_dir)).select("doc_id", "para", "seq", "text")


def chapter_tree(spark, sf_dir):
    tree = structure.chapters(roles.classify(_noted(spark, sf_dir)))
    return tree.withColumn("parent_id", F.coalesce("parent_id", F.lit(-1)))  # -1 for those at the top


def chapter_text(spark, sf_dir):
    return structure.chapter_text(roles.classify(_noted(spark, sf_dir)))


def heading_counts(spark, sf_dir):
    return structure.heading_counts(structure.chapters(roles.classify(_noted(spark, sf_dir))))


def note_pages(spark, sf_dir):
    rows = _blocks(spark, sf_dir).withColumns({"role": F.lit("body"), "endnote_num": F.when((F.col("page") >= 2) & (F.col("seq") % 3 == 0), F.col("seq"))})
    return structure.note_pages(rows)


def note_merge(spark, sf_dir):
    rows = structure.split_notes(roles.classify(_noted(spark, sf_dir)))
    return structure.merge_notes(rows.where("part = 'notes' AND NOT by_role")).select("doc_id", "seq", "endnote_num", "text")


def note_refs(spark, sf_dir):
    rows = notes.references(_blocks(spark, sf_dir, _ref()), names=("bracket",)).select("doc_id", "seq", F.explode("refs").alias("r"))
    return rows.select("doc_id", "seq", "r.num", "r.start", "r.end")


def note_tags(spark, sf_dir):
    rows = notes.tag(roles.classify(_varied(spark, sf_dir, _ref())))
    return rows.select("doc_id", "seq", "role", F.coalesce(F.array_join(F.transform("footnote_refs", lambda r: r["num"].cast("string")), ","), F.lit("")).alias("nums"))


_STYLES = (" [3]", " (4)", " word.5 x", " word6 x", " see note 7", " none", " end. 8  on", " word 9 ) so", " [10] and note 11, x.12 or y13")
_STYLE_SQL = "[" + ", ".join(f"'{m}'" for m in _STYLES) + f"][i % {len(_STYLES)} + 1]"


def _style_mark():
    return F.element_at(F.array(*map(F.lit, _STYLES)), F.col("i") % len(_STYLES) + 1)


def note_style(spark, sf_dir):
    return _blocks(spark, sf_dir, _style_mark()).select("doc_id", "seq", notes.style(F.col("text")).alias("style"))


def note_patterns(spark, sf_dir):
    """References of all seven patterns."""
    rows = notes.references(_blocks(spark, sf_dir, _style_mark()), names=tuple(notes.PATTERNS)).select("doc_id", "seq", F.explode("refs").alias("r"))
    return rows.select("doc_id", "seq", "r.num", "r.start", "r.end")


def note_hyperlinks(spark, sf_dir):
    return notes.link(_blocks(spark, sf_dir, _ref()), "text", F.lit("notes.xhtml")).select("doc_id", "seq", "text")


def note_html(spark, sf_dir):
    rows = _blocks(spark, sf_dir).select("doc_id", "seq", F.when(F.col("seq") % 3 > 0, F.col("seq")).alias("endnote_num"), F.concat(F.col("seq") + 1, F.lit(". "), "text").alias("text"))
    return notes.notes_html(rows)


def note_numbers(spark, sf_dir):
    rows = structure.split_notes(roles.classify(_noted(spark, sf_dir)))
    found = notes.note_numbers(structure.merge_notes(rows.where("part = 'notes'")))
    return found.select("doc_id", F.array_join("numbers", ",").alias("numbers"))


def _rendered(spark, sf_dir, lines=None):
    """A chapter of references to notes 1 to 9 and a chapter of notes 1 to 12, a line's each; some don't meet."""
    lines = _blocks(spark, sf_dir) if lines is None else lines
    link = F.concat(F.lit('<a href="chapter2.xhtml#note'), F.col("seq") % 9 + 1, F.lit('">x</a>'))
    note = F.concat(F.lit('<p class="endnote" id="note'), F.col("seq") % 12 + 1, F.lit('">n</p>'))

    def chapter(no: int, html):
        return lines.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(html)), "").alias("html")).select("doc_id", F.lit(no).alias("chapter_no"), "html")

    return chapter(1, link).union(chapter(2, note))


def note_links(spark, sf_dir):
    return notes.link_stats(_rendered(spark, sf_dir))


def image_names(spark, sf_dir):
    return images.name_images(_images(spark, sf_dir)).select("doc_id", "image_no", "id", "filename")


def image_sizes(spark, sf_dir):
    size = images.fitted(F.col("p_size") * 50, F.col("p_size") * 70)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


def _chaptered(spark, sf_dir):
    rows = structure.assign_chapters(roles.classify(_blocks(spark, sf_dir)))
    return rows.withColumn("root_no", F.col("chapter_id"))


def image_sequence(spark, sf_dir):
    return order.number_images(_images(spark, sf_dir)).select("doc_id", "image_no", "image_seq", "anchor")


def nearest_block(spark, sf_dir):
    return links.nearest_chapter(order.number_images(_images(spark, sf_dir)), _chaptered(spark, sf_dir)).select("doc_id", "image_seq", "chapter_id")


def page_images(spark, sf_dir):
    return links.images_by_page(order.number_images(_images(spark, sf_dir)), _chaptered(spark, sf_dir))


def render_order(spark, sf_dir):
    placed = links.nearest_chapter(order.number_images(_images(spark, sf_dir)), _chaptered(spark, sf_dir))
    return order.interleave(_chaptered(spark, sf_dir), placed).select("doc_id", "chapter_id", "kind", "ref", "place")


def figure_links(spark, sf_dir):
    rows = _blocks(spark, sf_dir, F.concat(F.lit(" see Fig. "), F.col("i") % 5 + 1)).withColumn("root_no", F.lit(1))
    pictures = order.number_images(_images(spark, sf_dir)).withColumn("root_no", F.col("image_seq"))
    return links.link_figures(rows, pictures).select("doc_id", "seq", "text")


def text_html(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", render.text_html(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("html"))


def rendered_chapters(spark, sf_dir):
    pictures = images.name_images(_images(spark, sf_dir))
    return convert.convert(_noted(spark, sf_dir), images=pictures)


def book_round_trip(spark, sf_dir):
    """Books written and read again: doc_id, chapters, characters of text."""
    books = checkpointed(convert.to_books(_noted(spark, sf_dir), _docs(spark, sf_dir)))
    files = books.select(F.col("doc_id").cast("string").alias("path"), F.col("epub").alias("content"))
    read = epub.map_arrow(files, epub._read, epub.CHAPTERS)
    per = read.groupBy("path").agg(F.count("*").alias("n_chapters"), F.max("error").alias("error"))
    return per.join(epub.full_text(read), "path", "left").select(F.col("path").cast("long").alias("doc_id"), "n_chapters", "error", F.length("text").alias("n_chars"))


def conversion_report(spark, sf_dir):
    """With none to three images a document, of which the third has a format that no book can have."""
    laid = checkpointed(structure.laid_out(roles.classify(_noted(spark, sf_dir))))
    pictures = _images(spark, sf_dir).where("image_no <= doc_id % 4")
    counts = [df.groupBy("doc_id").agg(F.count("*").alias("n")) for df in (pictures, images.name_images(pictures))]
    stats = validate.conversion_stats(_docs(spark, sf_dir), structure.chapter_text_of(laid), structure.chapters_of(laid), notes.link_stats(_rendered(spark, sf_dir, _noted(spark, sf_dir))), *counts)
    return validate.summary_text(stats)


def text_html_notes(spark, sf_dir):
    """Plain text as paragraphs, with links to the notes of documents of even ids."""
    rows = _docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit(" [3] end. 7\n\n")).alias("text"))
    return render.linked_html(rows.withColumn("file", F.when(F.col("doc_id") % 2 == 0, "notes.xhtml")), F.col("file"))


def image_formats(spark, sf_dir):
    """Target formats of images with and without transparency."""
    kind = F.element_at(F.array(*map(F.lit, ("png", "JPEG", "gif", "bmp"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    clear = F.col("p_size") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", images.target_format(kind, clear).alias("kept"), images.target_format(kind, clear, True).alias("converted"))


def image_savings(spark, sf_dir):
    """Bytes before and after, of files that lose a third of their text."""
    rows = _docs(spark, sf_dir).withColumn("doc_id", F.col("doc_id") % 50)
    after = rows.withColumn("data", F.encode(F.substring("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 3).cast("int")), "UTF-8"))
    return images.savings(rows.withColumn("data", F.encode("text", "UTF-8")), after)


QUERIES = {
    f.__name__: f
    for f in (
        derived_blocks, structural_blocks, page_text, scan_blocks, scanned_text, noise_lines, noise_strip, header_footer, page_filters, y_sort, xy_cut, side_blocks, style_histogram, body_style, style_roles,
        layout_profile, heading_score, block_roles, merge_headers, paragraphs, chapter_tree, chapter_text, heading_counts, note_pages, note_merge, note_refs, note_patterns, note_tags, note_style,
        note_hyperlinks, note_html, note_numbers, note_links, image_names, image_sizes, image_sequence, nearest_block, page_images, render_order, figure_links, text_html,
        rendered_chapters, book_round_trip, conversion_report, text_html_notes, image_formats, image_savings,
    )
}

_B = derive_sql()
_STYLE = f"""{_B},
hist AS (SELECT doc_id, font_name, round(font_size, 1) AS size, flags, sum(length(trim(text)))::BIGINT AS n_chars, min(seq) AS first_seq FROM blocks GROUP BY 1, 2, 3, 4),
body AS (SELECT doc_id, font_name AS body_font, size AS body_size, flags AS body_flags FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC, first_seq) AS k FROM hist) WHERE k = 1)"""
_ROLES = f"""{_STYLE},
kinds AS (SELECT hist.*, CASE WHEN font_name = body_font AND size = body_size AND flags = body_flags THEN 'body' WHEN size > body_size * 1.2e0 THEN 'header' WHEN size < body_size * 0.9e0 THEN 'footnote_or_small'
  WHEN flags & 16 <> 0 THEN 'strong' ELSE 'body_variant' END AS kind FROM hist JOIN body USING (doc_id)),
roles AS (SELECT doc_id, font_name, size, flags, n_chars, first_seq, CASE WHEN kind = 'header' THEN 'h' || least(6, row_number() OVER (PARTITION BY doc_id, kind ORDER BY size DESC, first_seq)) ELSE kind END AS style_role FROM kinds)"""


def _score_sql(first: str) -> str:
    return f"""{first},
nb AS (SELECT b.*, trim(text) AS t, body_size, body_flags, lag(page) OVER w AS pp, lag(y1) OVER w AS py1, lead(page) OVER w AS np, lead(y0) OVER w AS ny0 FROM blocks b JOIN body USING (doc_id) WINDOW w AS (PARTITION BY b.doc_id ORDER BY seq)),
gp AS (SELECT *, CASE WHEN pp IS NULL THEN y0 - y1 WHEN pp = page THEN y0 - py1 ELSE 0 END AS above, CASE WHEN np IS NULL THEN y0 - y1 WHEN np = page THEN ny0 - y1 ELSE 0 END AS below,
  t <> '' AND (regexp_matches(t, '^\\p{{Ll}}') OR ((contains(t, ',') OR contains(t[:-2], '.')) AND t[-1] NOT IN ('.', ':', ';', '?', '!'))) AS carried FROM nb),
pt AS (SELECT *, [CASE WHEN flags & 16 <> 0 AND body_flags & 16 = 0 THEN 30.0e0 END, CASE WHEN font_size - body_size > 0.5e0 THEN (font_size - body_size) * 10 END, CASE WHEN t[-1] NOT IN ('.', ':', ';', '?', '!', ',') THEN 20 END,
  CASE WHEN length(t) < 150 THEN 10 END, CASE WHEN length(t) < 50 THEN 5 END, CASE WHEN upper(t) = t AND lower(t) <> t AND length(t) > 4 THEN 10 END,
  CASE WHEN above > body_size * 1.2e0 * 1.5e0 AND NOT carried THEN 10 END, CASE WHEN above > below * 1.5e0 AND below > 0 AND NOT carried THEN 15 END] AS p FROM gp),
sc AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE coalesce(list_sum(p), 0) END AS score, CASE WHEN t = '' THEN '' ELSE array_to_string(list_filter([CASE WHEN p[1] IS NOT NULL THEN 'Bold' END,
  CASE WHEN p[2] IS NOT NULL THEN printf('Size+%.1f', font_size - body_size) END, CASE WHEN p[3] IS NOT NULL THEN 'NoPunct' END, CASE WHEN p[4] IS NOT NULL THEN 'Short' END, CASE WHEN p[6] IS NOT NULL THEN 'ALLCAPS' END,
  CASE WHEN p[7] IS NOT NULL THEN 'TopMargin' END, CASE WHEN p[8] IS NOT NULL THEN 'Top>Bottom' END], lambda x: x IS NOT NULL), ',') END AS signals FROM pt)"""


def _roles_sql(documents: str = "") -> str:
    return f"""{documents}{_score_sql(_ROLES)},
r1 AS (SELECT sc.*, coalesce(style_role, 'body') AS sr, font_size - sc.body_size AS diff, CASE WHEN score >= 80 THEN 'h1' WHEN score >= 65 THEN 'h2' WHEN score >= 50 THEN 'h3' ELSE 'body' END AS r
  FROM sc LEFT JOIN roles ON roles.doc_id = sc.doc_id AND roles.font_name = sc.font_name AND roles.size = round(font_size, 1) AND roles.flags = sc.flags),
r2 AS (SELECT *, CASE WHEN sr = 'h1' THEN 'h1' WHEN sr = 'h2' AND r = 'body' THEN 'h2' ELSE r END AS ra FROM r1),
r3 AS (SELECT *, CASE WHEN ra[1] = 'h' AND diff <= 0.3e0 THEN CASE WHEN flags & 16 <> 0 THEN 'h3' ELSE 'body' END ELSE ra END AS rb FROM r2),
r4 AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)^(Part|Chapter)\\s+([IVXLC]+|\\d+)\\b') AND flags & 16 <> 0 AND diff >= 0.5e0 THEN 'h1' ELSE rb END AS rc FROM r3),
r5 AS (SELECT *, CASE WHEN rc = 'body' AND (starts_with(t, '•') OR starts_with(t, '- ') OR regexp_matches(t, '^\\d+\\.\\s')) THEN 'list-item' ELSE rc END AS rd,
  CASE WHEN font_size <= body_size + 0.5e0 THEN try_cast(nullif(regexp_extract(t, '^(\\d{{1,2}})\\s{{2,}}', 1), '') AS INT) END AS en FROM r4),
cl AS (SELECT doc_id, seq, page, x0, y0, x1, y1, font_name, font_size, flags, text, CASE WHEN rd = 'body' AND en BETWEEN 1 AND 99 THEN 'endnote' ELSE rd END AS role, CASE WHEN en BETWEEN 1 AND 99 THEN en END AS endnote_num FROM r5)"""


_HEADERS = """mh AS (
  SELECT doc_id, min(seq) AS seq, arg_min(role, seq) AS role, arg_min(page, seq) AS page, arg_min(x0, seq) AS x0, arg_min(y0, seq) AS y0, arg_min(y1, seq) AS y1, arg_min(font_size, seq) AS font_size, string_agg(text, ' ' ORDER BY seq) AS text FROM (
    SELECT *, sum(CASE WHEN regexp_matches(role, '^h[0-9]+$') AND prev = role THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS run
    FROM (SELECT *, lag(role) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM {0})) GROUP BY doc_id, run)"""
_IMAGES = """img AS (SELECT doc_id, k AS image_no, k % 2 + 1 AS page, k * 100.0e0 AS y0, 60.0e0 AS x0, ['png', 'JPEG', 'bmp'][k] AS format FROM (SELECT doc_id, unnest([1, 2, 3]) AS k FROM documents)),
seqd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, image_no) AS image_seq FROM img)"""
_CHAPTERED = f"""{_roles_sql()}, ch AS (SELECT *, sum(CASE WHEN regexp_matches(role, '^h[0-9]+$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq)::INT AS chapter_id FROM cl)"""
_NEAR = f"""{_CHAPTERED}, {_IMAGES},
nr AS (SELECT doc_id, image_seq, first(page) AS page, first(y0) AS y0, first(x0) AS x0, arg_min(chapter_id, far * 100000 + seq) AS chapter_id FROM (
  SELECT s.*, ch.chapter_id, ch.seq, abs(s.page - ch.page) * 10000 + abs(s.y0 - ch.y0) AS far FROM seqd s JOIN ch USING (doc_id)) GROUP BY 1, 2)"""
_BODY_SIZE = """bs AS (SELECT doc_id, CASE WHEN pages >= 2 THEN size END AS body_size FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k
  FROM (SELECT doc_id, round(font_size, 1) AS size, sum(length(text)) AS n, min(seq) AS f FROM blocks WHERE page <= 100 GROUP BY 1, 2)) JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM blocks WHERE page <= 100 GROUP BY 1) USING (doc_id) WHERE k = 1)"""
_NOISE = """SELECT doc_id, pattern, n_pages, first_seq FROM (
  SELECT doc_id, regexp_replace(trim(text), '\\d+', '#', 'g') AS pattern, count(DISTINCT page) AS n_pages, min(seq) AS first_seq FROM blocks WHERE page <= 100 AND length(trim(text)) >= 10 GROUP BY 1, 2)
  JOIN (SELECT doc_id, count(DISTINCT page) AS sampled FROM blocks WHERE page <= 100 GROUP BY 1) USING (doc_id) WHERE sampled >= 2 AND n_pages >= greatest(2, 0.2e0 * sampled)"""
_HF = """(y1 <= {0}e0 * 0.08e0 OR y0 >= {0}e0 * 0.92e0) AND NOT coalesce(body_size <> 0 AND font_size >= body_size * 1.2e0, false) AND t <> ''
  AND (regexp_matches(t, '^[^\\p{{L}}\\p{{M}}_]+$') OR (d > 0 AND ((d / length(t) >= 0.3e0 AND w <= 8) OR (l > 0 AND u / l >= 0.6e0 AND w <= 10))) OR (l > 0 AND u / l >= 0.75e0 AND length(t) <= 80))""".format(PAGE_HEIGHT)
def _edge(table: str, sizes: str) -> str:
    return f"""SELECT *, {_HF} AS is_edge FROM (SELECT {table}.*, body_size, trim(text) AS t, len(regexp_extract_all(trim(text), '\\p{{L}}')) AS l, len(regexp_extract_all(trim(text), '\\p{{Lu}}')) AS u,
      len(regexp_extract_all(trim(text), '\\p{{Nd}}')) AS d, len(regexp_extract_all(trim(text), '\\S+')) AS w FROM {table} LEFT JOIN {sizes} AS _sizes USING (doc_id))"""


_PATTERNS = "SELECT doc_id, list(replace(regexp_escape(pattern), '\\#', '\\d+') ORDER BY first_seq) AS patterns FROM ({0}) GROUP BY 1"
_STRIPPED = "list_reduce(list_prepend(text, coalesce(patterns, []::VARCHAR[])), lambda t, p: regexp_replace(t, p, '', 'g'))"
#: Spans of the derived blocks (the first word, and the rest), and the blocks that are made of them again.
_SPANNED = f"""{_B}, spans AS (SELECT * EXCLUDE (text, flags, seq), seq AS block_no, unnest([0, 1]) AS span_no, unnest([16, 0]) AS flags, unnest([regexp_extract(text, '^\\S*'), substr(text, length(regexp_extract(text, '^\\S*')) + 1)]) AS text FROM blocks),
sb AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, block_no) - 1)::INT AS seq, page, x0, y0, x1, y1, font_name, font_size, flags, text FROM (
  SELECT doc_id, block_no, page, x0, y0, x1, y1, font_name, font_size, arg_max(flags, length(text) * 2 - span_no) AS flags, string_agg(text || ' ', '' ORDER BY span_no) AS text FROM spans WHERE trim(text) <> '' GROUP BY ALL EXCLUDE ()))"""
_SPANNED = _SPANNED.replace("GROUP BY ALL EXCLUDE ()", "GROUP BY doc_id, block_no, page, x0, y0, x1, y1, font_name, font_size")
_LINES = f"""ln AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, seq) - 1)::INT AS seq, page, seq AS block_no, y0, y1, font_size, trim(text) AS text FROM blocks WHERE trim(text) <> ''),
pats AS ({_PATTERNS.format(_NOISE.replace("FROM blocks", "FROM ln"))})"""
#: The body size as spans tell it; the number of a style's first span is about its block's.
_SPAN_BODY = """(SELECT doc_id, CASE WHEN pages >= 2 THEN size END AS body_size FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k
  FROM (SELECT doc_id, round(font_size, 1) AS size, sum(length(text)) AS n, min(block_no) AS f FROM spans WHERE page <= 100 GROUP BY 1, 2)) JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM spans WHERE page <= 100 GROUP BY 1) USING (doc_id) WHERE k = 1)"""
_PAGES = f"""{_LINES}, e AS ({_edge("ln", _SPAN_BODY)}),
k AS (SELECT doc_id, page, block_no, trim({_STRIPPED}) AS text FROM e LEFT JOIN pats USING (doc_id) WHERE NOT is_edge),
pt AS (SELECT doc_id, page, {CANONICAL.format("string_agg(text, chr(10) || chr(10) ORDER BY block_no)")} AS text FROM k WHERE text <> '' GROUP BY 1, 2)"""
_CONTINUES = """CASE WHEN pt IS NULL THEN false WHEN pt[-1] = '-' THEN true WHEN pt[-1] NOT IN ('.', '!', '?', ':', ';') AND regexp_matches(t, '^\\p{Ll}') THEN true
  WHEN gap > lh * 1.5e0 THEN false WHEN ind > th * 1.5e0 AND gap >= lh * 0.6e0 THEN false ELSE gap <= lh * 0.75e0 AND abs(ind) <= th END"""

_LINK_STATS = """l AS (SELECT doc_id, seq % 9 + 1 AS num FROM blocks), n AS (SELECT DISTINCT doc_id, seq % 12 + 1 AS num FROM blocks),
      k AS (SELECT n.doc_id, n.num, count(l.num) AS c FROM n LEFT JOIN l ON l.doc_id = n.doc_id AND l.num = n.num GROUP BY 1, 2),
ls AS (SELECT doc_id, count(*) AS n_notes, sum(c)::BIGINT AS n_links, count(*) FILTER (c > 0) AS n_linked, count(*) FILTER (c = 0) AS n_missing FROM k GROUP BY 1)"""
#: The reference patterns without looking around: what stands before, what is marked, what stands behind.
_REF_PARTS = {
    "bracket": ("", "\\[\\d{1,2}\\]", ""),
    "paren": ("", "\\(\\d{1,2}\\)", ""),
    "period": ("[\\p{L}\\p{N}_]", "\\.\\d{1,2}", "\\s|$|[,;:!?]"),
    "superscript": ("[a-zA-Z]", "\\d{1,2}", "\\s|$|[.,;:!?]"),
    "spaced": ("[.!?;:)\\]”\"''][\\t ]+", "\\d{1,2}", "[\\t ]{2,}|$|[\\t ]*[,.;:!?…]"),
    "spaced_closer": ("[\\p{L}\\p{N}_][\\t ]+", "\\d{1,2}", "[\\t ]*[\\])]"),
    "keyword": ("(?i:\\b(?:endnotes?|notes?))\\s+", "\\d{1,2}", "\\b"),
}


def _refs_sql(table: str, text: str, names, out: str) -> str:
    """``out``: ``table`` with refs, a list of (s, k, v): the start, the pattern's number and what is marked; one for each start."""
    marked = ", ".join(f"string_split(regexp_replace({text}, '({a})({m})({z})', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS _p{k}" for k, (a, m, z) in enumerate(_REF_PARTS[n] for n in names))
    found = [f"[{{'s': coalesce(list_sum([length(x) - contains(x, chr(2))::INT FOR x IN _p{k}[1:i - 1]]), 0)::INT, 'k': {k}, 'v': split_part(_p{k}[i], chr(2), 1)}} FOR i IN range(2, len(_p{k}) + 1)]" for k in range(len(names))]
    every = found[0]
    for more in found[1:]:
        every = f"list_concat({every}, {more})"
    gone = ", ".join(f"_p{k}" for k in range(len(names)))
    return f"""{out}_m AS (SELECT *, {marked} FROM {table}),
{out}_l AS (SELECT * EXCLUDE ({gone}), list_sort(list_filter({every}, lambda r: regexp_extract(r.v, '\\d+')::INT BETWEEN 1 AND 99)) AS _every FROM {out}_m),
{out} AS (SELECT * EXCLUDE (_every), [_every[i] FOR i IN range(1, len(_every) + 1) IF i = 1 OR _every[i].s <> _every[i - 1].s] AS refs FROM {out}_l)"""


def _linked_sql(text: str, file: str) -> str:
    """``text`` with its refs as links into ``file``, from the last to the first."""
    return f"""list_reduce(list_prepend({text}, list_reverse([r.s || ':' || (r.s + length(r.v)) || ':' || regexp_extract(r.v, '\\d+')::INT FOR r IN refs])), lambda t, r: substr(t, 1, split_part(r, ':', 1)::INT)
      || '<a href="' || {file} || '#note' || split_part(r, ':', 3) || '" class="footnote-ref"><sup>' || split_part(r, ':', 3) || '</sup></a>' || substr(t, split_part(r, ':', 2)::INT + 1))"""


def _escaped_sql(text: str) -> str:
    return f"replace(replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def _note_sql(text: str, num: str) -> str:
    """A note as a paragraph."""
    note = "'(?s)^\\d{1,3}[.)]?\\s+(.*)$'"
    content = f"CASE WHEN regexp_matches({text}, {note}) THEN trim(regexp_extract({text}, {note}, 1)) ELSE {text} END"
    n = f"coalesce({num}, try_cast(CASE WHEN regexp_matches({text}, {note}) THEN regexp_extract({text}, '^\\d+') END AS INT))"
    return f"CASE WHEN {n} IS NULL THEN '    <p class=\"endnote\">' || {_escaped_sql(text)} || '</p>' ELSE '    <p class=\"endnote\" id=\"note' || {n} || '\"><span class=\"endnote-num\">' || {n} || '.</span> ' || {_escaped_sql(content)} || '</p>' END"


def _merged_sql(name: str, where: str) -> str:
    """``name``: the notes that the blocks of ``sp`` make, of those in the notes part that ``where`` holds for."""
    strict, loose = "'(?s)^\\s*(\\d{1,3})\\s{2,}(.*)$'", "'(?s)^\\s*(\\d{1,3})[.)]?\\s+(.*)$'"
    return f"""{name}_t AS (SELECT *, trim(text) AS t, min(x0) OVER (PARTITION BY doc_id) AS lx FROM sp WHERE part = 'notes' AND {where} AND trim(text) <> ''),
{name}_p AS (SELECT *, try_cast(nullif(CASE WHEN regexp_matches(t, {strict}) THEN regexp_extract(t, {strict}, 1) ELSE regexp_extract(t, {loose}, 1) END, '') AS INT) AS pn0,
  trim(CASE WHEN regexp_matches(t, {strict}) THEN regexp_extract(t, {strict}, 2) ELSE regexp_extract(t, {loose}, 2) END) AS pc FROM {name}_t WHERE NOT (starts_with(upper(t), 'ENDNOTES') AND length(t) <= 80)),
{name}_n AS (SELECT *, CASE WHEN pn0 BETWEEN 1 AND 300 THEN pn0 END AS pn FROM {name}_p),
{name}_s AS (SELECT *, role = 'endnote' OR endnote_num IS NOT NULL OR (pn IS NOT NULL AND x0 - lx <= greatest(24.0e0, 4.0e0 * greatest(font_size, 1.0e0))) AS st, coalesce(endnote_num, pn) AS num FROM {name}_n),
{name}_g AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS note, CASE WHEN NOT st THEN t WHEN pn = num THEN pc WHEN num IS NULL THEN t ELSE trim(regexp_replace(t, '^\\s*' || num || '(?:[.)])?\\s+', '')) END AS piece FROM {name}_s),
{name}_a AS (SELECT doc_id, note, min(seq) AS seq, arg_min(page, seq) AS page, arg_min(x0, seq) AS x0, arg_min(y0, seq) AS y0, arg_min(y1, seq) AS y1, arg_min(font_size, seq) AS font_size, first(num ORDER BY seq) AS endnote_num,
  coalesce(string_agg(piece, ' ' ORDER BY seq) FILTER (piece <> ''), '') AS content FROM {name}_g WHERE note > 0 AND (st OR NOT regexp_matches(role, '^h[0-9]+$')) GROUP BY 1, 2),
{name} AS (SELECT doc_id, seq, page, x0, y0, y1, font_size, endnote_num, CASE WHEN content = '' THEN endnote_num::VARCHAR ELSE endnote_num || '  ' || content END AS text FROM {name}_a WHERE endnote_num IS NOT NULL)"""


def _tree_sql(blocks: str = _B) -> str:
    """Classified blocks of the noted documents in chapters: sp, hd, ns (notes), ev (the chapters)."""
    return f"""{_roles_sql(_NOTED_SQL + ', ').replace(_B, blocks)},
ti AS (SELECT doc_id, min(seq) AS ts, arg_min(trim(text), seq) AS title FROM cl WHERE starts_with(upper(trim(text)), 'ENDNOTES') AND length(trim(text)) <= 80 GROUP BY 1),
sp AS (SELECT cl.*, ts IS NULL AS by_role, CASE WHEN ts IS NULL THEN CASE WHEN role = 'endnote' THEN 'notes' ELSE 'main' END WHEN seq < ts THEN 'main' WHEN seq = ts THEN 'title' ELSE 'notes' END AS part, title FROM cl LEFT JOIN ti USING (doc_id)),
mn AS (SELECT * FROM sp WHERE part = 'main'), {_HEADERS.format("mn")},
hd AS (SELECT *, CASE WHEN regexp_matches(role, '^h[0-9]+$') THEN role[2:]::INT END AS h, sum(CASE WHEN regexp_matches(role, '^h[0-9]+$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq)::INT AS chapter_id FROM mh),
pr AS (SELECT c.doc_id, c.chapter_id, CASE WHEN c.h = 1 THEN NULL ELSE coalesce((SELECT max(p.chapter_id) FROM hd p WHERE p.doc_id = c.doc_id AND p.h < c.h AND p.seq < c.seq), 0) END AS parent_id FROM hd c WHERE c.h IS NOT NULL),
ch AS (SELECT doc_id, chapter_id, parent_id, coalesce(max(h), 0) AS level, CASE WHEN chapter_id = 0 THEN 'Intro' ELSE trim(arg_min(text, seq)) END AS title, count(*) AS n_blocks, min(seq) AS first_seq
  FROM hd LEFT JOIN pr USING (doc_id, chapter_id) GROUP BY 1, 2, 3),
it AS (SELECT DISTINCT doc_id, 0 AS chapter_id, NULL::INT AS parent_id, 0 AS level, 'Intro' AS title, 0 AS n_blocks, -1 AS first_seq FROM ch WHERE parent_id = 0 AND doc_id NOT IN (SELECT doc_id FROM ch WHERE chapter_id = 0)),
{_merged_sql("nm", "NOT by_role")},
ns AS (SELECT * FROM nm UNION ALL SELECT doc_id, seq, page, x0, y0, y1, font_size, endnote_num, text FROM sp WHERE part = 'notes' AND by_role),
nt AS (SELECT doc_id, count(*) AS n_blocks, min(seq) AS first_seq FROM ns GROUP BY 1),
e0 AS (SELECT *, false AS is_endnotes FROM (SELECT * FROM ch UNION ALL SELECT * FROM it) UNION ALL
  SELECT nt.doc_id, coalesce((SELECT max(chapter_id) FROM ch WHERE ch.doc_id = nt.doc_id), 0) + 1, NULL, 1, coalesce(ti.title, 'Endnotes'), n_blocks, first_seq, true FROM nt LEFT JOIN ti USING (doc_id)),
ev AS (SELECT doc_id, chapter_id, parent_id, level, title, n_blocks, first_seq, is_endnotes, sum(CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chapter_id)::INT AS root_no FROM e0)"""


def _islands_sql(name: str, table: str, keys: str) -> str:
    """``name``: rows of ``table`` (t not blank) with para; ``alone`` marks those that stand alone."""
    return f"""{name}_l AS (SELECT *, lag(t) OVER w AS pt, lag(alone) OVER w AS palone, greatest(0, y0 - lag(y1) OVER w) AS gap, x0 - lag(x0) OVER w AS ind, greatest(font_size, lag(font_size) OVER w, 1) * 1.25e0 AS lh,
  greatest(font_size, lag(font_size) OVER w, 1) * 1.2e0 AS th FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY seq)),
{name} AS (SELECT *, sum(CASE WHEN alone OR coalesce(palone, true) OR NOT ({_CONTINUES}) THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY seq) AS para FROM {name}_l)"""


_CHAPTER_TEXT = f"""{_tree_sql()},
bt AS (SELECT *, trim(text) AS t, false AS alone FROM (SELECT doc_id, chapter_id, seq, text, x0, y0, y1, font_size FROM hd UNION ALL SELECT doc_id, 1 << 30, seq, text, x0, y0, y1, font_size FROM ns) WHERE trim(text) <> ''),
{_islands_sql("bi", "bt", "doc_id, chapter_id")},
bp AS (SELECT doc_id, chapter_id, para, min(seq) AS seq, string_agg(t, ' ' ORDER BY seq) AS text FROM bi GROUP BY 1, 2, 3),
ct AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chapter_id, seq) AS text FROM bp GROUP BY 1)"""
#: Blocks in reading order, with side blocks last.
_ORDERED = f"""{derive_sql(name="raw")},
ow AS (SELECT *, max(x1) OVER p - min(x0) OVER p AS wd, count(*) OVER p AS c FROM raw WINDOW p AS (PARTITION BY doc_id, page)),
os AS (SELECT *, CASE WHEN wd > 0 THEN (x1 - x0) / wd END AS sh FROM ow),
om AS (SELECT doc_id, page, coalesce(list(x0 ORDER BY x0) FILTER (sh >= 0.4e0), list(x0 ORDER BY x0)) AS l, coalesce(list(x1 ORDER BY x1) FILTER (sh >= 0.4e0), list(x1 ORDER BY x1)) AS r FROM os GROUP BY 1, 2),
oz AS (SELECT os.*, coalesce(c >= 3 AND wd > 0 AND sh < 0.5e0 AND (x1 < l[len(l) // 2 + 1] OR x0 > r[len(r) // 2 + 1]), false) AS side FROM os JOIN om USING (doc_id, page)),
blocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, side, y0, x0, seq) - 1)::INT AS seq, page, x0, y0, x1, y1, font_name, font_size, flags, text FROM oz)"""


def _rendered_sql(images: bool) -> str:
    """rd: the chapters' files. The documents refer to no figures."""
    pictures = f"""{_IMAGES.replace("FROM documents", "FROM main.documents")},
im AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, image_no) AS iseq, printf('image%03d.%s', row_number() OVER (PARTITION BY doc_id ORDER BY page, image_no), lower(format)) AS file FROM img WHERE lower(format) <> 'bmp'),
pl AS (SELECT im.*, coalesce(n.chapter_id, 0) AS chapter_id FROM im LEFT JOIN (SELECT im.doc_id, iseq, arg_min(ma.chapter_id, (abs(im.page - ma.page) * 10000 + abs(im.y0 - ma.y0)) * 100000 + ma.seq) AS chapter_id FROM im JOIN ma USING (doc_id) GROUP BY 1, 2) n USING (doc_id, iseq)),
pc AS (SELECT pl.doc_id, pl.chapter_id, ev.root_no, 'figure' AS role, '<figure class="chapter-image" id="img-' || iseq || '">' || chr(10) || '  <img src="images/' || file || '" alt="Figure ' || iseq || '"/>' || chr(10) || '</figure>' AS t,
  page, x0, y0, y0 AS y1, 0.0e0 AS font_size, 'image' AS kind, iseq AS ref FROM pl JOIN ev USING (doc_id, chapter_id))"""
    items = "SELECT doc_id, chapter_id, root_no, role, trim(text) AS t, page, x0, y0, y1, font_size, 'text' AS kind, seq AS ref FROM ma WHERE trim(text) <> '' AND NOT (starts_with(role, 'h') AND trim(text) = title)"
    items = f"{pictures}, ri AS ({items} UNION ALL SELECT * FROM pc)" if images else f"ri AS ({items})"
    return f"""{_tree_sql(_ORDERED)},
ma AS (SELECT hd.*, ev.root_no, ev.title FROM hd JOIN ev USING (doc_id, chapter_id)), {items},
rs AS (SELECT *, kind = 'image' OR regexp_matches(role, '^h[0-9]+$') AS alone, row_number() OVER (PARTITION BY doc_id, chapter_id ORDER BY page, y0, x0, kind = 'image', ref) AS seq FROM ri), {_islands_sql("rl", "rs", "doc_id, chapter_id")},
rp AS (SELECT doc_id, chapter_id, root_no, para, min(seq) AS seq, arg_min(role, seq) AS role, arg_min(kind, seq) AS kind, string_agg(t, ' ' ORDER BY seq) AS text FROM rl GROUP BY 1, 2, 3, 4),
re AS (SELECT rp.*, {_escaped_sql('text')} AS esc, home.root_no AS home FROM rp LEFT JOIN (SELECT doc_id, root_no FROM ev WHERE is_endnotes) home USING (doc_id)), {_refs_sql("re", "esc", notes.DEFAULT, "rr")},
rh AS (SELECT doc_id, root_no, chapter_id, seq, CASE WHEN kind = 'image' THEN text WHEN regexp_matches(role, '^h[0-9]+$') THEN '<h' || greatest(2, least(6, role[2:]::INT)) || '>' || esc || '</h' || greatest(2, least(6, role[2:]::INT)) || '>'
  ELSE '<p>' || CASE WHEN home IS NULL THEN esc ELSE {_linked_sql("esc", "'chapter' || home || '.xhtml'")} END || '</p>' END AS html FROM rr UNION ALL
  SELECT doc_id, root_no, chapter_id, 0, '<h' || greatest(2, least(6, level)) || '>' || {_escaped_sql('title')} || '</h' || greatest(2, least(6, level)) || '>' FROM ev WHERE parent_id IS NOT NULL),
rf AS (SELECT doc_id, root_no, string_agg(html, chr(10) ORDER BY chapter_id, seq, html) AS html FROM rh GROUP BY 1, 2),
rn AS (SELECT doc_id, string_agg({_note_sql("trim(text)", "endnote_num")}, chr(10) ORDER BY seq) AS notes FROM ns GROUP BY 1),
rd AS (SELECT doc_id, root_no AS chapter_no, title, greatest(1, least(3, level)) AS level, coalesce(CASE WHEN is_endnotes THEN notes ELSE html END, '') AS html, is_endnotes
  FROM ev LEFT JOIN rf USING (doc_id, root_no) LEFT JOIN rn USING (doc_id) WHERE parent_id IS NULL)"""


ORACLES = {
    "derived_blocks": f"WITH {_B} SELECT * FROM blocks",
    "noise_lines": f"WITH {_VARIED_SQL}, {_B} {_NOISE}",
    "header_footer": f"WITH {_VARIED_SQL}, {_B}, {_BODY_SIZE} SELECT doc_id, seq, body_size, is_edge FROM ({_edge('blocks', 'bs')})",
    "structural_blocks": f"""WITH {_VARIED_SQL}, {_SPANNED} SELECT * FROM sb""",
    "page_text": f"WITH {_VARIED_SQL}, {_SPANNED}, {_PAGES} SELECT * FROM pt",
    "scanned_text": f"WITH {_VARIED_SQL}, {_SPANNED}, {_PAGES} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pt GROUP BY 1",
    "scan_blocks": f"""WITH {_VARIED_SQL}, {_SPANNED}, {_LINES}, e AS ({_edge("sb", _SPAN_BODY)}),
      k AS (SELECT doc_id, seq, trim({CANONICAL.format(_STRIPPED)}, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM e LEFT JOIN pats USING (doc_id) WHERE NOT is_edge)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k.seq) - 1)::INT AS seq, page, x0, y0, x1, y1, font_name, font_size, flags, k.text FROM k JOIN (SELECT * EXCLUDE text FROM sb) USING (doc_id, seq) WHERE k.text <> ''""",
    "noise_strip": f"WITH {_VARIED_SQL}, {_B}, pats AS ({_PATTERNS.format(_NOISE)}) SELECT doc_id, seq, {_STRIPPED} AS text FROM blocks LEFT JOIN pats USING (doc_id)",
    "xy_cut": f"WITH {_B} SELECT doc_id, seq AS was, (row_number() OVER (PARTITION BY doc_id ORDER BY page, seq % 2, seq) - 1)::INT AS seq FROM blocks",
    "page_filters": f"""WITH {_B}, p AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS n FROM blocks)
      SELECT doc_id, seq, page FROM p WHERE page >= 1 AND page <= n AND page <> 2 AND y1 > {PAGE_HEIGHT}e0 * 0.05e0 AND y0 < {PAGE_HEIGHT}e0 * 0.95e0""",
    "y_sort": f"WITH {_B} SELECT doc_id, seq AS was, (row_number() OVER (PARTITION BY doc_id ORDER BY page, 700.0e0 - y0, x0, seq) - 1)::INT AS seq FROM blocks",
    "side_blocks": f"""WITH {_B}, n AS (SELECT doc_id, seq, page, y0, CASE WHEN seq % 5 = 3 THEN 800.0e0 ELSE x0 END AS x0, CASE WHEN seq % 5 = 3 THEN 860.0e0 ELSE x1 END AS x1 FROM blocks),
      w AS (SELECT *, max(x1) OVER p - min(x0) OVER p AS wd, count(*) OVER p AS c FROM n WINDOW p AS (PARTITION BY doc_id, page)),
      s AS (SELECT *, CASE WHEN wd > 0 THEN (x1 - x0) / wd END AS sh FROM w),
      m AS (SELECT doc_id, page, coalesce(list(x0 ORDER BY x0) FILTER (sh >= 0.4e0), list(x0 ORDER BY x0)) AS l, coalesce(list(x1 ORDER BY x1) FILTER (sh >= 0.4e0), list(x1 ORDER BY x1)) AS r FROM s GROUP BY 1, 2),
      z AS (SELECT s.*, coalesce(c >= 3 AND wd > 0 AND sh < 0.5e0 AND (x1 < l[len(l) // 2 + 1] OR x0 > r[len(r) // 2 + 1]), false) AS side FROM s JOIN m USING (doc_id, page))
      SELECT doc_id, seq AS was, (row_number() OVER (PARTITION BY doc_id ORDER BY page, side, y0, x0, seq) - 1)::INT AS seq FROM z""",
    "style_histogram": f"WITH {_STYLE} SELECT * FROM hist",
    "body_style": f"WITH {_STYLE} SELECT * FROM body",
    "style_roles": f"WITH {_ROLES} SELECT * FROM roles",
    "layout_profile": f"""WITH {_B}, t AS (SELECT doc_id, max(page) AS page_count FROM blocks GROUP BY 1),
      s AS (SELECT doc_id, page_count, CASE WHEN page_count <= 5 THEN range(1, page_count + 1) ELSE list_transform(list_concat(list_distinct([0, page_count // 2, page_count - 1]),
        list_filter([3, 4, 1, 2], lambda x: NOT list_contains([0, page_count // 2, page_count - 1], x))[1:2]), lambda x: x + 1) END AS sampled FROM t),
      b AS (SELECT blocks.*, page_count, sampled FROM blocks JOIN s USING (doc_id) WHERE list_contains(sampled, page)),
      p AS (SELECT doc_id, page, count(DISTINCT round_even(x0 / 50, 0)) AS c, length(trim(string_agg(text, chr(10)))) AS n FROM b GROUP BY 1, 2),
      q AS (SELECT doc_id, max(n) > 20 AS has_text, list(c ORDER BY c)[count(*) // 2 + 1] AS med FROM p GROUP BY 1),
      z AS (SELECT doc_id, size AS body_size, u AS unique_sizes FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k, count(*) OVER (PARTITION BY doc_id) AS u
        FROM (SELECT doc_id, round(font_size, 1) AS size, count(*) AS n, min(seq) AS f FROM b GROUP BY 1, 2)) WHERE k = 1)
      SELECT doc_id, page_count, len(sampled)::INT AS n_sampled, has_text, med >= 2 AS multi_column, CASE WHEN med >= 2 THEN least(med, 3) ELSE 1 END::INT AS n_columns, body_size, unique_sizes,
        CASE WHEN med >= 2 THEN 'xy_cut' ELSE 'y_sort' END AS strategy FROM s JOIN q USING (doc_id) JOIN z USING (doc_id)""",
    "heading_score": f"WITH {_score_sql(_STYLE)} SELECT doc_id, seq, score, signals FROM sc",
    "block_roles": f"WITH {_roles_sql(_NOTED_SQL + ', ')} SELECT doc_id, seq, role, coalesce(endnote_num, 0) AS endnote_num FROM cl",
    "merge_headers": f"WITH {_roles_sql()}, {_HEADERS.format('cl')} SELECT doc_id, seq, role, text FROM mh",
    "paragraphs": f"""WITH {_B}, n AS (SELECT *, trim(text) AS t FROM blocks WHERE trim(text) <> ''),
      l AS (SELECT *, lag(t) OVER w AS pt, greatest(0, y0 - lag(y1) OVER w) AS gap, x0 - lag(x0) OVER w AS ind, greatest(font_size, lag(font_size) OVER w, 1) * 1.25e0 AS lh, greatest(font_size, lag(font_size) OVER w, 1) * 1.2e0 AS th
        FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
      p AS (SELECT *, sum(CASE WHEN {_CONTINUES} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS para FROM l)
      SELECT doc_id, para::BIGINT AS para, min(seq) AS seq, string_agg(t, ' ' ORDER BY seq) AS text FROM p GROUP BY 1, 2""",
    "chapter_tree": f"WITH {_tree_sql()} SELECT * REPLACE (coalesce(parent_id, -1) AS parent_id) FROM ev",
    "chapter_text": f"WITH {_CHAPTER_TEXT} SELECT doc_id, text FROM ct",
    "heading_counts": f"WITH {_tree_sql()} SELECT doc_id, count(*) AS n_headings, count(*) FILTER (parent_id IS NULL) AS n_roots FROM ev GROUP BY 1",
    "note_merge": f"WITH {_tree_sql()} SELECT doc_id, seq, endnote_num, text FROM nm",
    "note_numbers": f"WITH {_tree_sql()}, {_merged_sql('nn', 'true')} SELECT doc_id, string_agg(endnote_num::VARCHAR, ',' ORDER BY endnote_num) AS numbers FROM nn GROUP BY 1",
    "note_tags": f"""WITH {_roles_sql(_VARIED_SQL + ', ').replace(_B, derive_sql(_REF_SQL))}, {_refs_sql("cl", "text", notes.DEFAULT, "rf")}
      SELECT doc_id, seq, role, CASE WHEN role IN ('body', 'list-item') THEN array_to_string([regexp_extract(r.v, '\\d+')::INT FOR r IN refs], ',') ELSE '' END AS nums FROM rf""",
    "note_patterns": f"""WITH {derive_sql(_STYLE_SQL)}, {_refs_sql("blocks", "text", list(_REF_PARTS), "rf")}
      SELECT doc_id, seq, regexp_extract(r.v, '\\d+')::INT AS num, r.s AS start, (r.s + length(r.v))::INT AS "end" FROM (SELECT doc_id, seq, unnest(refs) AS r FROM rf)""",
    "note_style": f"WITH {derive_sql(_STYLE_SQL)} SELECT doc_id, seq, CASE " + " ".join(f"WHEN regexp_matches(text, '(?:{a})(?:{m})(?:{z})') THEN '{n}'" for n, (a, m, z) in _REF_PARTS.items()) + " END AS style FROM blocks",
    "note_hyperlinks": f"""WITH {derive_sql(_REF_SQL)}, {_refs_sql("blocks", "text", notes.DEFAULT, "rf")} SELECT doc_id, seq, {_linked_sql("text", "'notes.xhtml'")} AS text FROM rf""",
    "note_html": f"""WITH {_B}, n AS (SELECT doc_id, seq, CASE WHEN seq % 3 > 0 THEN seq END AS num, trim((seq + 1) || '. ' || text) AS t FROM blocks)
      SELECT doc_id, string_agg({_note_sql("t", "num")}, chr(10) ORDER BY seq) AS html FROM n GROUP BY 1""",
    "figure_links": f"""WITH {derive_sql("' see Fig. ' || (i % 5 + 1)")} SELECT doc_id, seq, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\b(Fig(?:ure)?\\.?)\\s*0*1\\b', '<a href="#img-1" class="figure-ref">\\1 1</a>', 'g'),
      '(?i)\\b(Fig(?:ure)?\\.?)\\s*0*2\\b', '<a href="chapter2.xhtml#img-2" class="figure-ref">\\1 2</a>', 'g'), '(?i)\\b(Fig(?:ure)?\\.?)\\s*0*3\\b', '<a href="chapter3.xhtml#img-3" class="figure-ref">\\1 3</a>', 'g') AS text FROM blocks""",
    "text_html": f"""SELECT doc_id, array_to_string([('    <p>' || {_escaped_sql('trim(x)')} || '</p>') FOR x IN string_split(text, chr(10)) IF trim(x) <> ''], chr(10)) AS html FROM documents""",
    "text_html_notes": f"""WITH p AS (SELECT doc_id, k, {_escaped_sql('trim(x)')} AS esc FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT doc_id, string_split(replace(text, chr(10), ' [3] end. 7' || chr(10)), chr(10)) AS l FROM documents)) WHERE trim(x) <> ''),
      {_refs_sql("p", "esc", notes.DEFAULT, "rf")} SELECT doc_id, string_agg('    <p>' || CASE WHEN doc_id % 2 = 0 THEN {_linked_sql("esc", "'notes.xhtml'")} ELSE esc END || '</p>', chr(10) ORDER BY k) AS html FROM rf GROUP BY 1""",
    "image_formats": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 2 THEN 'gif' ELSE 'jpeg' END AS kept,
      CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 'png' WHEN p_partkey % 4 = 2 THEN 'gif' ELSE 'jpeg' END AS converted FROM part""",
    "image_savings": """SELECT doc_id, b AS bytes_before, a AS bytes_after, (b - a) * 100.0::DOUBLE / b AS saved_percent FROM (
      SELECT doc_id % 50 AS doc_id, sum(strlen(text))::BIGINT AS b, sum(strlen(substr(text, 1, length(text) - length(text) // 3)))::BIGINT AS a FROM documents GROUP BY 1)""",
    "rendered_chapters": f"WITH {_rendered_sql(True)} SELECT * FROM rd",
    "book_round_trip": f"""WITH {_rendered_sql(False)},
      pg AS (SELECT doc_id, chapter_no, {CANONICAL.format(TAGLESS.format("'<title>' || " + _escaped_sql("title") + " || '</title><h1>' || " + _escaped_sql("title") + " || '</h1>' || html"))} AS text FROM rd)
      SELECT doc_id, count(*) AS n_chapters, NULL::VARCHAR AS error, length(string_agg(text, chr(10) || chr(10) ORDER BY chapter_no) FILTER (trim(text) <> ''))::INT AS n_chars FROM pg GROUP BY 1""",
    "conversion_report": f"""WITH RECURSIVE {_CHAPTER_TEXT}, pairs AS (SELECT doc_id, d.text AS source, ct.text AS target FROM main.documents d JOIN ct USING (doc_id)), {_COMPLETE.split(validate.DAMAGED_SQL + ", ")[1].replace("src AS", "src AS", 1)}, {_LINK_STATS},
      sz AS (SELECT doc_id, d.text AS source, ct.text AS target FROM main.documents d LEFT JOIN ct USING (doc_id)),
      st AS (SELECT doc_id, len(regexp_extract_all(source, '\\S+')) AS sw, coalesce(len(regexp_extract_all(target, '\\S+')), 0) AS tw FROM sz),
      hc AS (SELECT doc_id, count(*) AS headings, count(*) FILTER (parent_id IS NULL) AS chapters, coalesce(sum(n_blocks) FILTER (is_endnotes), 0)::BIGINT AS notes FROM ev GROUP BY 1)
      SELECT doc_id, format('Words: {{:,}} of {{:,}} ({{:.1f}}%)', tw, sw, CASE WHEN sw > 0 THEN tw * 100.0 / sw ELSE 0 END::DOUBLE) || chr(10) || 'Chapters: ' || coalesce(chapters, 0) || ', headings: ' || coalesce(headings, 0) || ', notes: ' || coalesce(notes, 0) || chr(10)
        || 'Images: ' || least(doc_id % 4, 2) || ' of ' || least(doc_id % 4, 3) || chr(10) || format('Completeness: {{:.1f}}%, order: {{:.1f}}%', coalesce(completeness, 0), coalesce(order_score, 0)) || chr(10)
        || CASE WHEN coalesce(n_linked, 0) < coalesce(n_notes, 0) THEN 'ALERT: ' || n_linked || ' of ' || n_notes || ' notes are linked' || chr(10) ELSE '' END
        || CASE WHEN coalesce(completeness, 0) >= 95 AND coalesce(order_score, 0) >= 80 AND doc_id % 4 < 3 THEN 'PASS' ELSE 'NEEDS REVIEW' END AS report
      FROM st LEFT JOIN hc USING (doc_id) LEFT JOIN verdicts USING (doc_id) LEFT JOIN ls USING (doc_id)""",
    "note_pages": f"""WITH {_B}, s AS (SELECT doc_id, page, count(*) AS n FROM blocks WHERE page >= 2 AND seq % 3 = 0 GROUP BY 1, 2),
      g AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY page DESC) - page - 1 AS gap FROM s), f AS (SELECT *, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page DESC) AS far FROM g),
      r AS (SELECT doc_id, min(page) AS first_page, max(page) AS ls FROM f WHERE far = 0 GROUP BY 1 HAVING sum(n) >= 5 AND count(*) >= 2)
      SELECT doc_id, first_page, CASE WHEN mp - ls <= 3 THEN mp ELSE ls END AS last_page FROM r JOIN (SELECT doc_id, max(page) AS mp FROM blocks GROUP BY 1) USING (doc_id)""",
    "note_refs": f"""WITH {derive_sql(_REF_SQL)}
      SELECT doc_id, seq, num::INT AS num, (length(text) - length(num) - 2)::INT AS start, length(text)::INT AS "end" FROM (SELECT *, regexp_extract(text, '\\[(\\d{{1,2}})\\]$', 1) AS num FROM blocks)""",
    "note_links": f"WITH {_B}, {_LINK_STATS} SELECT * FROM ls",
    "image_names": f"""WITH {_IMAGES} SELECT doc_id, image_no, 'img-page-' || page || '-' || image_no AS id, printf('image%03d.%s', row_number() OVER (PARTITION BY doc_id ORDER BY page, image_no), lower(format)) AS filename
      FROM img WHERE lower(format) <> 'bmp'""",
    "image_sizes": """SELECT p_partkey, floor(p_size * 50 * s)::INT AS width, floor(p_size * 70 * s)::INT AS height
      FROM (SELECT *, least(1200::DOUBLE / (p_size * 50), 1600::DOUBLE / (p_size * 70), 1.0::DOUBLE) AS s FROM part)""",
    "image_sequence": f"WITH {_IMAGES} SELECT doc_id, image_no, image_seq::INT AS image_seq, 'img-' || image_seq AS anchor FROM seqd",
    "nearest_block": f"WITH {_NEAR} SELECT doc_id, image_seq::INT AS image_seq, chapter_id FROM nr",
    "page_images": f"WITH {_CHAPTERED}, {_IMAGES} SELECT DISTINCT seqd.doc_id, chapter_id, image_seq::INT AS image_seq FROM seqd JOIN ch ON ch.doc_id = seqd.doc_id AND ch.page = seqd.page",
    "render_order": f"""WITH {_NEAR} SELECT doc_id, chapter_id, kind, ref::INT AS ref, row_number() OVER (PARTITION BY doc_id, chapter_id ORDER BY page, y0, x0, kind = 'image', ref)::INT AS place FROM (
      SELECT doc_id, chapter_id, 'text' AS kind, page, y0, x0, seq AS ref FROM ch UNION ALL SELECT doc_id, chapter_id, 'image', page, y0, x0, image_seq FROM nr)""",
}
