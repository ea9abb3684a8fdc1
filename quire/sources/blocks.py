"""Block tables: the schema, flattening of nested spans, and blocks derived from plain documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip

#: A positioned, styled block of text; ``seq`` is its place in reading order, ``flags & 16`` is bold.
SCHEMA = "doc_id bigint, seq int, page int, x0 double, y0 double, x1 double, y1 double, font_name string, font_size double, flags int, text string"
#: One row per span as a layout reader delivers them.
SPANS = (
    "doc_id bigint, page int, page_height double, block_no int, block_type int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double, "
    "line_y0 double, line_y1 double, font_name string, font_size double, flags int, text string"
)
BOLD = 16


def is_bold(flags: Column) -> Column:
    return flags.bitwiseAND(BOLD) != 0


def _mode(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The value with most text, the first on a tie."""
    per = df.groupBy(*keys, value.alias(name)).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("line_no", "span_no")).alias("first"))
    return per.groupBy(*keys).agg(F.max_by(name, F.struct("n", (-F.col("first.line_no")).alias("l"), (-F.col("first.span_no")).alias("s"))).alias(name))


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """One row per text block: non-blank spans each followed by a blank; style and flags by most text, each by itself."""
    keys = ["doc_id", "page", "block_no"]
    kept = spans.where("block_type = 0").where(strip(F.col("text")) != "")
    parts = F.sort_array(F.collect_list(F.struct("line_no", "span_no", "text")))
    box = kept.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.lit(" "))), "").alias("text")
    )
    style = _mode(kept, keys, F.struct("font_name", "font_size"), "style")
    flags = _mode(kept, keys, F.col("flags"), "flags")
    out = box.join(style, keys).join(flags, keys)
    seq = (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block_no")) - 1).alias("seq")
    return out.select("doc_id", seq, "page", "x0", "y0", "x1", "y1", "style.font_name", "style.font_size", "flags", "text")


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """One row per non-blank text line: doc_id, seq, page, page_height, block_no, line_no, y0, y1, size (the largest span's), text."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("span_no", "text"))), lambda p: p["text"])
    lines = spans.where("block_type = 0").groupBy("doc_id", "page", "block_no", "line_no")
    lines = lines.agg(F.first("page_height").alias("page_height"), F.first("line_y0").alias("y0"), F.first("line_y1").alias("y1"), F.max("font_size").alias("size"), strip(F.array_join(parts, "")).alias("text"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block_no", "line_no")) - 1
    return lines.where("text <> ''").withColumn("seq", seq.cast("int"))


def page_text(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text) of lines: those of a block joined by blanks, blocks by empty lines."""
    joined = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda p: p["text"])
    blocks = lines.groupBy("doc_id", "page", "block_no").agg(F.array_join(joined, " ").alias("block"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block_no", "block"))), lambda p: p["block"])
    return blocks.groupBy("doc_id", "page").agg(F.array_join(ordered, "\n\n").alias("text"))


def derive(documents: DataFrame, mark: Column | None = None) -> DataFrame:
    """A synthetic layout of plain documents: a block per line, twenty to a page.

    It exercises the operators and says nothing about real pages. ``mark`` is put behind each
    line; it may use ``i``, the line's number from 0.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    i = F.col("i")
    text = F.concat(F.col("text"), mark) if mark is not None else F.col("text")
    lines = lines.select("doc_id", "i", text.alias("text"))
    on_page = i % 20
    y0, x0 = on_page * 36.0, F.lit(50.0) + 24.0 * (i % 3)
    size = F.when(on_page == 0, 18.0).when(i % 7 == 0, 14.0).when(i % 11 == 0, 9.0).otherwise(12.0)
    return lines.select(
        "doc_id",
        i.alias("seq"),
        (F.floor(i / 20) + 1).cast("int").alias("page"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.least(F.lit(450.0), 5.0 * F.length("text"))).alias("x1"),
        (y0 + 12.0 + 12.0 * (i % 2)).alias("y1"),
        F.lit("Serif").alias("font_name"),
        size.alias("font_size"),
        F.when((on_page == 0) | (i % 7 == 0), BOLD).otherwise(0).alias("flags"),
        "text",
    )


PAGE_HEIGHT = 720.0


def derive_sql(mark: str = "", name: str = "blocks") -> str:
    """The derived table as a DuckDB common table expression."""
    text = f"line || {mark}" if mark else "line"
    return f"""{name} AS (
  SELECT doc_id, i::INT AS seq, (i // 20 + 1)::INT AS page, 50.0e0 + 24.0e0 * (i % 3) AS x0, (i % 20) * 36.0e0 AS y0,
    50.0e0 + 24.0e0 * (i % 3) + least(450.0e0, 5.0e0 * length(text)) AS x1, (i % 20) * 36.0e0 + 12.0e0 + 12.0e0 * (i % 2) AS y1, 'Serif' AS font_name,
    CASE WHEN i % 20 = 0 THEN 18.0e0 WHEN i % 7 = 0 THEN 14.0e0 WHEN i % 11 = 0 THEN 9.0e0 ELSE 12.0e0 END AS font_size,
    CASE WHEN i % 20 = 0 OR i % 7 = 0 THEN 16 ELSE 0 END AS flags, text
  FROM (SELECT doc_id, i, {text} AS text FROM (SELECT doc_id, lines[i + 1] AS line, i FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))))"""
