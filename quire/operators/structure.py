"""Chapters, paragraphs and notes from classified blocks (doc_id, seq, page, box, style, text, role, endnote_num)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quire.functions.text import strip
from quire.operators.classify import is_heading

INTRO, NOTES = "Intro", "Endnotes"
TAIL_PAGES, GAP_PAGES, LEAST_STARTS, LEAST_PAGES = 3, 6, 5, 2
NOTES_TITLE_LENGTH = 80
MOST_NOTES = 300
LEVELS = 6
#: A note's number and text, and the looser form; fixed values.
NOTE_START = r"(?sU)^\s*(\d{1,3})\s{2,}(.*)$"
NOTE_START_LOOSE = r"(?sU)^\s*(\d{1,3})[.)]?\s+(.*)$"

_PLACE = ("page", "x0", "y0", "x1", "y1", "font_size")


def _by_seq() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("seq")


def merge_headers(blocks: DataFrame) -> DataFrame:
    """Neighbouring headings of one role become one block, their texts joined by blanks; the first's box and style stay."""
    order = _by_seq()
    heading = is_heading(F.col("role"))
    goes_on = heading & (F.lag("role").over(order) == F.col("role"))
    rows = blocks.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    first = [F.min_by(c, "seq").alias(c) for c in blocks.columns if c not in ("doc_id", "seq", "text")]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    merged = rows.groupBy("doc_id", "_run").agg(F.min("seq").alias("seq"), text.alias("text"), *first)
    return merged.select(*blocks.columns)


def is_notes_title(text: Column) -> Column:
    t = strip(text)
    return F.upper(t).startswith("ENDNOTES") & (F.length(t) <= NOTES_TITLE_LENGTH)


def _with_note_pages(blocks: DataFrame) -> DataFrame:
    """``blocks`` with first_page and last_page of their document's inferred notes, or nulls; by windows over doc_id.

    From the last page with a note start back, as long as no more than GAP_PAGES pages without one
    lie between; they need enough starts on enough pages.
    """
    doc, back = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy(F.col("page").desc())
    starts = (F.col("role") == "endnote") | F.col("endnote_num").isNotNull()
    rows = blocks.withColumn("_at", F.when(starts, F.col("page")))
    behind = F.min("_at").over(back.rangeBetween(Window.unboundedPreceding, -1))  # the next page with a start
    rows = rows.withColumn("_gap", F.when(F.col("_at").isNotNull() & (behind - F.col("page") - 1 > GAP_PAGES), 1).otherwise(0))
    near = F.sum("_gap").over(back.rangeBetween(Window.unboundedPreceding, 0)) == 0
    rows = rows.withColumn("_at", F.when(near, F.col("_at")))
    rows = rows.withColumns({"_n": F.count("_at").over(doc), "_pages": F.size(F.collect_set("_at").over(doc)), "_first": F.min("_at").over(doc), "_last": F.max("_at").over(doc), "_most": F.max("page").over(doc)})
    enough = (F.col("_n") >= LEAST_STARTS) & (F.col("_pages") >= LEAST_PAGES)
    last = F.when(F.col("_most") - F.col("_last") <= TAIL_PAGES, F.col("_most")).otherwise(F.col("_last"))
    rows = rows.withColumns({"first_page": F.when(enough, F.col("_first")), "last_page": F.when(enough, last)})
    return rows.drop("_at", "_gap", "_n", "_pages", "_first", "_last", "_most")


def note_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, first_page, last_page): the pages at a document's end that look like notes."""
    return _with_note_pages(blocks).where("first_page IS NOT NULL").groupBy("doc_id").agg(F.first("first_page").alias("first_page"), F.first("last_page").alias("last_page"))


def split_notes(blocks: DataFrame) -> DataFrame:
    """``blocks`` with part (main, notes or title), by_role and notes_title; by windows over doc_id.

    What follows the notes' title is notes; without one, inferred pages are; without those, only
    blocks with the role.
    """
    head = F.min(F.when(is_notes_title(F.col("text")), F.struct("seq", "text"))).over(Window.partitionBy("doc_id"))
    rows = _with_note_pages(blocks).withColumn("_head", head)
    seq, at = F.col("seq"), F.col("_head.seq")
    by_title = F.when(seq < at, "main").when(seq == at, "title").otherwise("notes")
    by_page = F.when(F.col("page").between(F.col("first_page"), F.col("last_page")), "notes").otherwise("main")
    by_role = F.when(F.col("role") == "endnote", "notes").otherwise("main")
    part = F.when(at.isNotNull(), by_title).when(F.col("first_page").isNotNull(), by_page).otherwise(by_role)
    rows = rows.withColumn("by_role", at.isNull() & F.col("first_page").isNull()).withColumn("part", part).withColumn("notes_title", strip(F.col("_head.text")))
    return rows.drop("_head", "first_page", "last_page")


def parse_note(text: Column) -> Column:
    """(num, content) of a note's start, or null."""
    t = strip(text)
    pattern = F.when(t.rlike(NOTE_START), F.lit(NOTE_START)).when(t.rlike(NOTE_START_LOOSE), F.lit(NOTE_START_LOOSE))
    strict, loose = F.regexp_extract(t, NOTE_START, 1), F.regexp_extract(t, NOTE_START_LOOSE, 1)
    num = F.nullif(F.when(pattern == NOTE_START, strict).otherwise(loose), F.lit("")).try_cast("int")
    content = F.when(pattern == NOTE_START, F.regexp_extract(t, NOTE_START, 2)).otherwise(F.regexp_extract(t, NOTE_START_LOOSE, 2))
    return F.when(num.between(1, MOST_NOTES), F.struct(num.alias("num"), strip(content).alias("content")))


def _note_parts(blocks: DataFrame, among: Column) -> DataFrame:
    """``blocks`` with _note, the number of the note that a row belongs to (0 or null for none), _num and _piece.

    Only rows that ``among`` holds for count. A note starts at a block with the role or a number,
    or that reads like a start at the left margin; what follows, but headings, belongs to it.
    """
    rows = blocks.withColumn("_t", strip(F.col("text")))
    rows = rows.withColumn("_left", F.min(F.when(among & (F.col("_t") != ""), F.col("x0"))).over(Window.partitionBy("doc_id")))
    rows = rows.withColumns({"_in": among & (F.col("_t") != "") & ~is_notes_title(F.col("_t")), "_p": F.when(among, parse_note(F.col("_t")))})
    margin = F.greatest(F.lit(24.0), 4.0 * F.greatest("font_size", F.lit(1.0)))
    starts = (F.col("role") == "endnote") | F.col("endnote_num").isNotNull() | (F.col("_p").isNotNull() & (F.col("x0") - F.col("_left") <= margin))
    num = F.coalesce("endnote_num", "_p.num")
    bare = F.when(num.isNull(), F.col("_t")).otherwise(strip(F.regexp_replace(F.col("_t"), F.concat(F.lit(r"(?U)^\s*"), num, F.lit(r"(?:[.)])?\s+")), F.lit(""))))
    first = F.when(F.col("_p.num") == num, F.col("_p.content")).otherwise(bare)
    rows = rows.withColumns({"_start": F.col("_in") & starts, "_num": num, "_first": first})
    rows = rows.withColumns({"_piece": F.when(F.col("_start"), F.col("_first")).otherwise(F.col("_t")), "_note": F.sum(F.col("_start").cast("int")).over(_by_seq())})
    rows = rows.withColumn("_note", F.when(F.col("_in") & (F.col("_start") | ~is_heading(F.col("role"))), F.col("_note")))
    return rows.drop("_t", "_left", "_in", "_p", "_start", "_first")


def _note_text(num: Column, pieces: Column) -> Column:
    """``n  content`` of a note's pieces, an array of (seq, _piece)."""
    content = strip(F.array_join(F.filter(F.transform(F.sort_array(pieces), lambda x: x["_piece"]), lambda x: x != ""), " "))
    return F.when(content == "", num.cast("string")).otherwise(F.concat(num, F.lit("  "), content))


def merge_notes(blocks: DataFrame) -> DataFrame:
    """One row per note of a notes section: doc_id, seq, page, box, font_size, endnote_num, text (``"n  content"``).

    Blocks before the first start, and notes without a number, are left out.
    """
    rows = _note_parts(blocks, F.lit(True)).where("_note > 0")
    one = rows.groupBy("doc_id", "_note").agg(F.min(F.struct("seq", *_PLACE, F.col("_num").alias("endnote_num"))).alias("f"), F.collect_list(F.struct("seq", "_piece")).alias("pieces"))
    return one.where("f.endnote_num IS NOT NULL").select("doc_id", "f.*", _note_text(F.col("f.endnote_num"), F.col("pieces")).alias("text"))


def _with_chapters(rows: DataFrame, part: WindowSpec) -> DataFrame:
    """``rows`` with chapter_id, level, parent_id and title, along ``part``, which is ordered by seq."""
    heading = is_heading(F.col("role"))
    level = F.when(heading, F.substring("role", 2, 2).cast("int"))
    rows = rows.withColumn("_h", level).withColumn("chapter_id", F.sum(heading.cast("int")).over(part).cast("int"))
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    # The last h1 so far cuts off everything before it; null while there is none.
    last = {k: F.max(F.when(F.col("_h") == k, F.col("chapter_id"))).over(before) for k in range(1, LEVELS + 1)}
    rows = rows.withColumns({f"_last{k}": v for k, v in last.items()})
    parent = F.lit(None).cast("int")
    for k in range(2, LEVELS + 1):
        smaller = F.greatest(*[F.col(f"_last{j}") for j in range(1, k)]) if k > 2 else F.col("_last1")
        parent = F.when(F.col("_h") == k, F.coalesce(smaller, F.lit(0))).otherwise(parent)
    return rows.withColumn("_parent", parent).drop(*[f"_last{k}" for k in range(1, LEVELS + 1)])


def assign_chapters(blocks: DataFrame) -> DataFrame:
    """``blocks`` in chapters: chapter_id, level, parent_id, title. Headings open one; id 0 is the introduction.

    A parent is the nearest chapter before with a smaller level, the introduction too until the
    first h1; an h1 has none.
    """
    rows = _with_chapters(blocks, _by_seq())
    chapter = Window.partitionBy("doc_id", "chapter_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "level": F.coalesce(F.first("_h").over(chapter), F.lit(0)),
            "parent_id": F.first("_parent").over(chapter),
            "title": F.when(F.col("chapter_id") == 0, INTRO).otherwise(strip(F.first("text").over(chapter))),
        }
    )
    return rows.drop("_h", "_parent")


def laid_out(blocks: DataFrame) -> DataFrame:
    """Classified ``blocks`` in chapters, headings and notes merged; one exchange by doc_id serves all steps.

    doc_id, seq, page, box, font_size, role, endnote_num, text, is_notes, chapter_id, root_no,
    level, parent_id, title, opens (the chapter's first row), n_blocks (of the chapter), and
    needs_intro on the first row of a document whose chapters hang on an introduction without
    blocks. Notes make a last chapter of level 1.
    """
    rows = split_notes(blocks).where("part <> 'title'")
    notes = F.col("part") == "notes"
    rows = _note_parts(rows, notes & ~F.col("by_role"))
    part = Window.partitionBy("doc_id", "part").orderBy("seq")
    goes_on = is_heading(F.col("role")) & (F.lag("role").over(part) == F.col("role"))
    rows = rows.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(part))
    group = F.when(~notes | F.col("by_role"), F.col("_run")).otherwise(F.when(F.col("_note") > 0, F.col("_note")))
    piece = F.when(notes & ~F.col("by_role"), F.col("_piece")).otherwise(F.col("text"))
    rows = rows.withColumns({"_group": group, "_piece": piece, "_num": F.when(notes & ~F.col("by_role"), F.col("_num")).otherwise(F.col("endnote_num"))})
    first = F.min(F.struct("seq", *_PLACE, "role", F.col("_num").alias("endnote_num"), "by_role", "notes_title")).alias("f")
    rows = rows.where("_group IS NOT NULL").groupBy("doc_id", "part", "_group").agg(first, F.collect_list(F.struct("seq", "_piece")).alias("pieces"))
    joined = F.array_join(F.transform(F.sort_array("pieces"), lambda x: x["_piece"]), " ")
    merged = notes & ~F.col("f.by_role")
    rows = rows.select("doc_id", "f.*", F.when(merged, _note_text(F.col("f.endnote_num"), F.col("pieces"))).otherwise(joined).alias("text"), notes.alias("is_notes"))
    rows = rows.where("NOT is_notes OR by_role OR endnote_num IS NOT NULL")

    rows = _with_chapters(rows, Window.partitionBy("doc_id", "is_notes").orderBy("seq"))
    doc = Window.partitionBy("doc_id")
    last = F.coalesce(F.max(F.when(~F.col("is_notes"), F.col("chapter_id"))).over(doc), F.lit(0))
    rows = rows.withColumn("chapter_id", F.when(F.col("is_notes"), last + 1).otherwise(F.col("chapter_id")))
    chapter = Window.partitionBy("doc_id", "chapter_id").orderBy("seq")
    whole = chapter.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    title = F.when(F.col("is_notes"), F.coalesce(F.max("notes_title").over(doc), F.lit(NOTES))).when(F.col("chapter_id") == 0, INTRO).otherwise(strip(F.first("text").over(whole)))
    rows = rows.withColumns(
        {
            "level": F.when(F.col("is_notes"), 1).otherwise(F.coalesce(F.first("_h").over(whole), F.lit(0))),
            "parent_id": F.when(~F.col("is_notes"), F.first("_parent").over(whole)),
            "title": title,
            "n_blocks": F.count(F.lit(1)).over(whole),
            "opens": F.row_number().over(chapter) == 1,
        }
    )
    order = Window.partitionBy("doc_id").orderBy("is_notes", "seq")
    intro = F.max((F.col("parent_id") == 0).cast("int")).over(doc) - F.max(((F.col("chapter_id") == 0) & ~F.col("is_notes")).cast("int")).over(doc) == 1
    rows = rows.withColumn("_intro", F.coalesce(intro, F.lit(False)))
    root = F.sum((F.col("opens") & F.col("parent_id").isNull()).cast("int")).over(order) + F.col("_intro").cast("int")
    rows = rows.withColumns({"root_no": root.cast("int"), "needs_intro": F.col("_intro") & (F.row_number().over(order) == 1)})
    return rows.drop("_h", "_parent", "_intro", "by_role", "notes_title")


def chapters(blocks: DataFrame) -> DataFrame:
    """doc_id, chapter_id, parent_id, root_no, level, title, is_endnotes, n_blocks, first_seq, of classified blocks.

    An introduction without blocks appears only if chapters hang on it. Notes make a last chapter
    of level 1 with chapter_id one above the others.
    """
    return chapters_of(laid_out(blocks))


def chapters_of(laid: DataFrame) -> DataFrame:
    """``chapters`` of what ``laid_out`` returns."""
    names = ("chapter_id", "parent_id", "root_no", "level", "title", "is_endnotes", "n_blocks", "first_seq")
    own = F.struct("chapter_id", "parent_id", "root_no", "level", "title", F.col("is_notes").alias("is_endnotes"), "n_blocks", F.col("seq").alias("first_seq"))
    values = (F.lit(0), F.lit(None).cast("int"), F.lit(1), F.lit(0), F.lit(INTRO), F.lit(False), F.lit(0).cast("long"), F.lit(-1))
    intro = F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])
    rows = laid.where("opens").select("doc_id", F.explode(F.when(F.col("needs_intro"), F.array(intro, own)).otherwise(F.array(own))).alias("c"))
    return rows.select("doc_id", "c.*")


def continues(previous: dict[str, Column], current: dict[str, Column]) -> Column:
    """Whether a block goes on the paragraph of the one before; both as text, x0, y0, y1, font_size."""
    last = F.substring(previous["text"], -1, 1)
    gap = F.greatest(F.lit(0.0), current["y0"] - previous["y1"])
    size = F.greatest(previous["font_size"], current["font_size"], F.lit(1.0))
    line, indent, most = size * 1.25, current["x0"] - previous["x0"], size * 1.2
    carried = ~last.isin(*".!?:;") & current["text"].rlike(r"(?U)^\p{Ll}")
    near = ~(gap > line * 1.5) & ~((indent > most * 1.5) & (gap >= line * 0.6)) & (gap <= line * 0.75) & (F.abs(indent) <= most)
    return (last == "-") | carried | near


def paragraph_islands(rows: DataFrame, keys: list[str], breaks: Column | None = None) -> DataFrame:
    """Non-blank ``rows`` with para, the number of their paragraph within ``keys`` by seq; ``breaks`` marks rows that stand alone."""
    rows = rows.withColumn("text", strip(F.col("text"))).where("text <> ''")
    order = Window.partitionBy(*keys).orderBy("seq")
    alone = breaks if breaks is not None else F.lit(False)
    names = ("text", "x0", "y0", "y1", "font_size")
    goes_on = continues({c: F.lag(c).over(order) for c in names}, {c: F.col(c) for c in names})
    rows = rows.withColumn("_alone", alone)
    new = F.col("_alone") | F.lag("_alone").over(order) | ~goes_on
    rows = rows.withColumn("_new", F.coalesce(new, F.lit(True)))
    return rows.withColumn("para", F.sum(F.col("_new").cast("int")).over(order)).drop("_alone", "_new")


def paragraphs(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per paragraph: keys, para, seq, text; blocks joined by blanks."""
    islands = paragraph_islands(rows, list(keys))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return islands.groupBy(*keys, "para").agg(F.min("seq").alias("seq"), text.alias("text"))


def chapter_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text) of classified blocks: chapters' paragraphs in document order, joined by empty lines; notes last.

    Depth-first order of the chapter tree is document order, so no recursion is needed.
    """
    return chapter_text_of(laid_out(blocks))


def chapter_text_of(laid: DataFrame) -> DataFrame:
    """``chapter_text`` of what ``laid_out`` returns."""
    parts = paragraphs(laid, ("doc_id", "chapter_id"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chapter_id", "seq", "text"))), lambda x: x["text"])
    return parts.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("text"))


def heading_counts(chapter_table: DataFrame) -> DataFrame:
    """(doc_id, n_headings, n_roots): all chapters, and those at the top."""
    return chapter_table.groupBy("doc_id").agg(F.count("*").alias("n_headings"), F.sum(F.col("parent_id").isNull().cast("int")).alias("n_roots"))
