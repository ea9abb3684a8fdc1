"""Chapters as HTML."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import escape_html, strip
from quire.operators import structure
from quire.operators.classify import is_heading
from quire.operators.links import figure_html, link_figures, nearest_chapter
from quire.operators.notes import DEFAULT, link, note_html
from quire.runtime import checkpointed

HEADING_FIRST, HEADING_LAST, CHAPTER_LAST = 2, 6, 3


def _paragraphs(text: Column) -> Column:
    """Non-blank paragraphs of plain text: cut at empty lines, other line breaks become blanks."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" "))))
    return F.filter(parts, lambda p: p != "")


def text_html(text: Column) -> Column:
    """Plain text as paragraphs."""
    return F.array_join(F.transform(_paragraphs(text), lambda p: F.concat(F.lit("    <p>"), escape_html(p), F.lit("</p>"))), "\n")


def linked_html(texts: DataFrame, notes_file: Column, patterns: Iterable[str] | None = None) -> DataFrame:
    """(doc_id, html) of texts (doc_id, text, …): ``text_html`` with note references as links, paragraph by paragraph.

    Where ``notes_file`` is null there are no links. Texts without a paragraph, null ones too, have none.
    """
    rows = texts.select("doc_id", notes_file.alias("_file"), F.posexplode_outer(_paragraphs(F.col("text"))).alias("seq", "html"))
    rows = link(rows.withColumn("html", F.when(F.col("html").isNotNull(), escape_html(F.col("html")))), "html", F.col("_file"), patterns or DEFAULT)
    tagged = F.concat(F.lit("    <p>"), "html", F.lit("</p>"))
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("html").isNotNull(), F.struct("seq", tagged.alias("h"))))), lambda x: x["h"])
    return rows.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("html"))


def _tagged(tag: Column, text: Column) -> Column:
    return F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">"))


def render_chapters(blocks: DataFrame, images: DataFrame | None = None, patterns: Iterable[str] | None = None, link_notes: bool = True, back_to: str | None = None) -> DataFrame:
    """(doc_id, chapter_no, title, level, html, is_endnotes): a row per file, that is per chapter at the top.

    ``blocks`` are classified; ``images`` are numbered (doc_id, image_seq, anchor, page, y0, x0,
    filename). Images go to the nearest block's chapter and stand between its paragraphs. Text is
    escaped, then figures and, if there are notes, note references become links. A heading that
    repeats its chapter's title is left out.
    """
    # Read once for the pictures and once for the text, and no larger than the blocks.
    laid = structure.laid_out(blocks)
    laid = checkpointed(laid) if images is not None else laid
    home = F.max(F.when(F.col("is_notes"), F.col("root_no"))).over(Window.partitionBy("doc_id"))
    laid = laid.withColumn("home", home if link_notes else F.lit(None).cast("int"))

    columns = ["doc_id", "chapter_id", "root_no", "home", "title", "role", "text", "page", "x0", "y0", "y1", "font_size", "kind", "ref"]
    items = laid.where("NOT is_notes").withColumns({"kind": F.lit("text"), "ref": F.col("seq")}).select(*columns)
    if images is not None:
        placed = checkpointed(nearest_chapter(images, laid.where("NOT is_notes")))
        known = structure.chapters_of(laid).where("NOT is_endnotes").select("doc_id", "chapter_id", "title")
        box = {"x0": F.coalesce("x0", F.lit(0.0)), "y0": F.coalesce("y0", F.lit(0.0))}
        figure = figure_html(F.col("image_seq"), F.col("page"), F.col("filename"), F.col("anchor"))
        rest = {"role": F.lit("figure"), "text": figure, "y1": box["y0"], "font_size": F.lit(0.0), "kind": F.lit("image"), "ref": F.col("image_seq"), "home": F.lit(None).cast("int")}
        items = items.unionByName(placed.join(known, ["doc_id", "chapter_id"]).withColumns(box | rest).select(*columns))
    items = items.withColumn("text", F.when(F.col("kind") == "text", strip(F.col("text"))).otherwise(F.col("text")))
    items = items.where((F.col("kind") == "image") | ((F.col("text") != "") & ~(F.col("role").startswith("h") & (F.col("text") == F.col("title")))))
    place = Window.partitionBy("doc_id", "chapter_id").orderBy("page", "y0", "x0", F.col("kind") == "image", "ref")
    items = items.withColumn("seq", F.row_number().over(place))
    heading = is_heading(F.col("role"))
    alone = (F.col("kind") == "image") | heading
    islands = structure.paragraph_islands(items, ["doc_id", "chapter_id"], alone)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    parts = islands.groupBy("doc_id", "chapter_id", "para").agg(F.min(F.struct("seq", "role", "kind", "root_no")).alias("f"), F.max("home").alias("home"), joined.alias("text"))
    parts = parts.select("doc_id", "chapter_id", "f.*", "home", "text")
    is_paragraph = (F.col("kind") == "text") & ~is_heading(F.col("role"))
    parts = parts.withColumn("html", F.when(is_paragraph, escape_html(F.col("text"))))
    if images is not None:
        parts = link_figures(parts, placed.select("doc_id", "image_seq", "anchor", "root_no"), "html")
    parts = link(parts, "html", F.concat(F.lit("chapter"), F.col("home"), F.lit(".xhtml")), patterns or DEFAULT)
    level = F.greatest(F.lit(HEADING_FIRST), F.least(F.lit(HEADING_LAST), F.substring("role", 2, 2).try_cast("int")))
    html = F.when(F.col("kind") == "image", F.col("text")).when(is_heading(F.col("role")), _tagged(F.concat(F.lit("h"), level), escape_html(F.col("text")))).otherwise(_tagged(F.lit("p"), F.col("html")))

    # A file's pieces: its chapters' parts, titles of those below the top, notes, and one that has the file's own title.
    def pieces(df: DataFrame, chapter, seq, html, title=None, level=None, is_endnotes=None) -> DataFrame:
        def own(value, kind: str):
            return (F.lit(None) if value is None else value).cast(kind)

        return df.select("doc_id", "root_no", own(chapter, "int").alias("c"), own(seq, "int").alias("s"), html.alias("html"), own(title, "string").alias("title"), own(level, "int").alias("level"), own(is_endnotes, "boolean").alias("is_endnotes"))

    table = structure.chapters_of(laid)
    title = _tagged(F.concat(F.lit("h"), F.greatest(F.lit(HEADING_FIRST), F.least(F.lit(HEADING_LAST), F.col("level")))), escape_html(F.col("title")))
    own_title = F.col("parent_id").isNull()
    heads = pieces(table, F.col("chapter_id"), F.lit(0), F.when(~own_title, title), F.when(own_title, F.col("title")), F.when(own_title, F.col("level")), F.when(own_title, F.col("is_endnotes")))
    noted = pieces(laid.where("is_notes"), F.col("chapter_id"), F.col("seq"), note_html(F.col("text"), F.col("endnote_num"), back_to))
    every = pieces(parts, F.col("chapter_id"), F.col("seq"), html).union(heads).union(noted)
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("html").isNotNull(), F.struct("c", "s", "html")))), lambda x: x["html"])
    files = every.groupBy("doc_id", "root_no").agg(F.max("title").alias("title"), F.max("level").alias("level"), F.array_join(ordered, "\n").alias("html"), F.max("is_endnotes").alias("is_endnotes"))
    return files.select("doc_id", F.col("root_no").alias("chapter_no"), "title", F.greatest(F.lit(1), F.least(F.lit(CHAPTER_LAST), F.col("level"))).alias("level"), "html", "is_endnotes")
