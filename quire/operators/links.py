"""Images to their nearest blocks, figure references to images, chapters by page."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import ship

PAGE_WEIGHT = 10_000.0
#: Words that refer to figures, and the number; fixed values.
FIGURES = (r"\b(Fig(?:ure)?\.?)\s*(\d{1,3})\b", r"\b(Рис(?:\.|унок)?\.?)\s*(\d{1,3})\b")


def nearest_chapter(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Images (doc_id, image_seq, page, y0, …) with chapter_id and root_no of the nearest block.

    Pages count most, then the distance of top edges; the earlier block wins a tie. Documents
    without blocks have chapter 0 and root 1. An image meets the blocks of its page, or of the
    nearest pages that have some.
    """
    order = Window.partitionBy("doc_id").orderBy("page")
    here = F.col("_has")
    pages = images.select("doc_id", "page", F.lit(0).alias("_b")).union(blocks.select("doc_id", "page", F.lit(1))).groupBy("doc_id", "page").agg(F.max("_b").alias("_b"))
    pages = pages.withColumn("_has", F.when(F.col("_b") == 1, F.col("page")))
    before, behind = F.last(here, ignorenulls=True).over(order), F.first(here, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    pages = pages.withColumns({"_before": before, "_behind": behind})
    least = F.least(F.col("page") - F.col("_before"), F.col("_behind") - F.col("page"))
    near_pages = F.array_distinct(F.filter(F.array("_before", "_behind"), lambda p: F.abs(p - F.col("page")) == least))
    pages = pages.select("doc_id", "page", F.explode(near_pages).alias("_page"))
    at = blocks.select("doc_id", F.col("seq").alias("_seq"), F.col("page").alias("_page"), F.col("y0").alias("_y0"), F.col("chapter_id").alias("_chapter"), F.col("root_no").alias("_root"))
    far = F.abs(F.col("page") - F.col("_page")) * PAGE_WEIGHT + F.abs(F.coalesce("y0", F.lit(0.0)) - F.col("_y0"))
    near = images.select("doc_id", "image_seq", "page", "y0").join(pages, ["doc_id", "page"]).join(at, ["doc_id", "_page"]).withColumn("_far", far)
    first = F.struct("_far", "_seq")
    near = near.groupBy("doc_id", "image_seq").agg(F.min_by("_chapter", first).alias("chapter_id"), F.min_by("_root", first).alias("root_no"))
    out = images.join(near, ["doc_id", "image_seq"], "left")
    return out.withColumns({"chapter_id": F.coalesce("chapter_id", F.lit(0)), "root_no": F.coalesce("root_no", F.lit(1))})


def link_figures(rows: DataFrame, images: DataFrame, text: str = "text", root: str = "root_no") -> DataFrame:
    """``text`` with figure references as links to ``images`` (doc_id, image_seq, anchor, root_no).

    A link within the chapter's own file has no file name; references without an image stay.
    """
    ship(rows.sparkSession)
    known = images.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("image_seq").cast("string"), F.struct("anchor", "root_no")))).alias("_images"))

    @F.pandas_udf("string")
    def linked(texts: pd.Series, roots: pd.Series, figures: pd.Series) -> pd.Series:
        patterns = [re.compile(p, re.IGNORECASE) for p in FIGURES]

        def one(t: str | None, own: int, some: dict | None) -> str | None:
            def put(m: re.Match) -> str:
                image = some.get(str(int(m[2])))
                if not image:
                    return m[0]
                file = "" if image["root_no"] == own else f"chapter{image['root_no']}.xhtml"
                return f'<a href="{file}#{image["anchor"]}" class="figure-ref">{m[1]} {int(m[2])}</a>'

            if t is None or not some:
                return t
            some = dict(some)
            for p in patterns:
                t = p.sub(put, t)
            return t

        return pd.Series([one(t, r, f) for t, r, f in zip(texts, roots, figures, strict=True)], dtype=object)

    # Texts without a figure's name stay in the JVM.
    hint = F.col(text).rlike(r"(?iU)fig|рис")
    out = rows.join(known, "doc_id", "left").withColumn("_out", linked(F.when(hint, F.col(text)), F.col(root), F.when(hint, F.col("_images"))))
    return out.withColumn(text, F.coalesce("_out", text)).drop("_out", "_images")


def images_by_page(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Images of each chapter on whose pages they stand: doc_id, chapter_id, image_seq."""
    pages = blocks.select("doc_id", "page", "chapter_id").distinct()
    return images.join(pages, ["doc_id", "page"]).select("doc_id", "chapter_id", "image_seq")


def contained(items: DataFrame, documents: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """(item_id, doc_id) where an item's text stands in a document's.

    A join without a key: items are broadcast in blocks of about ``block_bytes``, as many as it
    takes; the decontamination operators are the way for large tables of items.
    """
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    blocks = max(1, -(-total // block_bytes))

    def found(k: int) -> DataFrame:
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        small = F.broadcast(some.select("item_id", F.col("text").alias("item")))
        return documents.join(small, F.contains(F.col("text"), F.col("item"))).select("item_id", "doc_id")

    return reduce(DataFrame.union, [found(k) for k in range(blocks)])


# The markup of figures and of links to them is part of the contract; fixed values.
def figure_html(seq: Column, page: Column, filename: Column, anchor: Column) -> Column:
    alt = F.coalesce(F.concat(F.lit("Figure "), seq), F.concat(F.lit("Image from page "), page))
    return F.concat(F.lit('<figure class="chapter-image" id="'), anchor, F.lit('">\n  <img src="images/'), filename, F.lit('" alt="'), alt, F.lit('"/>\n</figure>'))
