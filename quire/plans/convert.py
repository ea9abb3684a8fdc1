"""From blocks to books: order, classify, build chapters, render, write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import canonicalize, strip
from quire.operators import images, noise, render, structure
from quire.operators.classify import classify
from quire.operators.notes import link_stats
from quire.operators.order import number_images, order_blocks, xy_cut
from quire.plans import validate
from quire.sources import blocks as source
from quire.sources.config import Config
from quire.sources.epub import books

#: Strategies by name; others may be added.
STRATEGIES: dict[str, Callable[[DataFrame, Config], DataFrame]] = {}


def _page_noise(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, repeated lines and body sizes of spans."""
    lines = source.lines_from_spans(spans)
    order = Window.partitionBy("doc_id").orderBy("page", "block_no", "line_no", "span_no")
    sized = spans.where("block_type = 0").withColumn("seq", F.row_number().over(order))
    return lines, noise.repeated_lines(lines), noise.body_size(sized)


def scan_blocks(spans: DataFrame) -> DataFrame:
    """Blocks of spans without headers, footers and repeated lines, their texts in canonical form; blank ones go."""
    _, patterns, body = _page_noise(spans)
    heights = spans.groupBy("doc_id", "page").agg(F.first("page_height").alias("page_height"))
    rows = source.blocks_from_spans(spans).join(heights, ["doc_id", "page"]).join(body, "doc_id", "left")
    edge = noise.is_header_footer(F.col("text"), F.col("y0"), F.col("y1"), F.col("page_height"), F.col("font_size"), F.col("body_size"))
    rows = canonicalize(noise.strip_repeated(rows.where(~edge), patterns), "text").withColumn("text", strip(F.col("text"))).where("text <> ''")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return rows.withColumn("seq", seq.cast("int")).select(*[c.split()[0] for c in source.SCHEMA.split(", ")])


def scan_pages(spans: DataFrame) -> DataFrame:
    """(doc_id, page, text): the same by lines, for validation."""
    lines, patterns, body = _page_noise(spans)
    rows = lines.join(body, "doc_id", "left")
    edge = noise.is_header_footer(F.col("text"), F.col("y0"), F.col("y1"), F.col("page_height"), F.col("size"), F.col("body_size"))
    rows = noise.strip_repeated(rows.where(~edge), patterns).withColumn("text", strip(F.col("text"))).where("text <> ''")
    return canonicalize(source.page_text(rows), "text")


def full_text(spans: DataFrame) -> DataFrame:
    """(doc_id, text): page texts joined by empty lines."""
    pages = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return scan_pages(spans).groupBy("doc_id").agg(F.array_join(pages, "\n\n").alias("text"))


def _without_edges(blocks: DataFrame, config: Config) -> DataFrame:
    """Blocks outside the excluded shares of their pages, as page_height and page_width tell; an error where those are needed and missing."""
    edges = config.exclude_regions
    for name, low, high, drop in (("page_height", edges.top, edges.bottom, noise.drop_regions), ("page_width", edges.left, edges.right, noise.drop_margins)):
        if low or high:
            if name not in blocks.columns:
                raise ValueError(f"exclude_regions needs blocks with a column {name}")
            blocks = drop(blocks, F.col(name), low, 1 - high)
    return blocks


def prepared(blocks: DataFrame, config: Config) -> DataFrame:
    """Configured pages and regions, in reading order, with roles."""
    pages = config.page_ranges
    if pages.start is not None or pages.end is not None or pages.skip:
        blocks = noise.keep_pages(blocks, pages.start, pages.end, pages.skip)
    rows = _without_edges(blocks, config)
    if config.multi_column.enabled and config.multi_column.column_count > 1:
        rows = xy_cut(rows)  # column by column; side blocks would be moved behind all of them
    else:
        rows = order_blocks(rows, config.reading_order_strategy).drop("confidence")
    return classify(rows, config.heading_detection.font_size_threshold)


def simple(blocks: DataFrame, config: Config) -> DataFrame:
    return prepared(blocks, config)


STRATEGIES["simple"] = simple


def optimized(pictures: DataFrame, config: Config) -> DataFrame:
    """Named images, scaled and encoded as configured, where they have data and an image library is there; else as they are."""
    own = config.image_optimization
    if not own.enabled or "data" not in pictures.columns or not images.can_optimize():
        return pictures
    return images.optimize(pictures, own.max_width, own.max_height, own.jpeg_quality, own.convert_png_to_jpeg)


def convert(blocks: DataFrame, config: Config | None = None, images: DataFrame | None = None) -> DataFrame:
    """Rendered chapters of a block table; see ``render.render_chapters``."""
    config = config or Config()
    rows = STRATEGIES[config.strategy](blocks, config)
    notes = config.footnote_processing
    back_to = "chapter1.xhtml" if notes.generate_backlinks else None
    return render.render_chapters(rows, number_images(images) if images is not None else None, notes.patterns, notes.enabled, back_to)


def text_of(blocks: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, text): what the chapters of a block table say."""
    return structure.chapter_text(prepared(blocks, config or Config()))


def metadata(documents: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, title, author, language, publisher, description, isbn): settings first, then the file's own, then Unknown."""
    config = config or Config()

    def own(name: str):
        return F.nullif(F.col(name), F.lit("")) if name in documents.columns else F.lit(None).cast("string")

    def first(setting: str | None, name: str):
        return F.coalesce(F.lit(setting or None), own(name), F.lit("Unknown"))

    return documents.select(
        "doc_id",
        first(config.metadata.title, "title").alias("title"),
        first(config.metadata.author, "author").alias("author"),
        F.lit(config.metadata.language or "en").alias("language"),
        own("producer").alias("publisher"),
        own("subject").alias("description"),
        F.lit(None).cast("string").alias("isbn"),
    )


def to_books(blocks: DataFrame, documents: DataFrame, config: Config | None = None, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, epub) of a block table, its documents' metadata, and named images with data."""
    config = config or Config()
    if images is None:
        return books(convert(blocks, config), metadata(documents, config))
    pictures = optimized(images, config)
    return books(convert(blocks, config, pictures), metadata(documents, config), number_images(pictures))


def reported(blocks: DataFrame, config: Config | None = None, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): how the text of a block table comes through the conversion."""
    config = config or Config()
    rows = STRATEGIES[config.strategy](blocks, config)
    laid = structure.laid_out(rows)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("page", "seq", "text"))), lambda x: x["text"])
    own = blocks.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"))
    rendered = convert(blocks, config, images)
    counts = (None, None) if images is None else (images.groupBy("doc_id").agg(F.count("*").alias("n")), validate.images_in(rendered))
    return validate.summary_text(validate.conversion_stats(own, structure.chapter_text_of(laid), structure.chapters_of(laid), link_stats(rendered), *counts))
