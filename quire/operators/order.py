"""Reading order of blocks: by position, by recursive cuts, with side blocks last."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import map_arrow

WIDE, NARROW, LEAST_BLOCKS = 0.4, 0.5, 3
#: Rows that are gathered before their pages are cut.
_PAGE_ROWS = 10_000


def _renumbered(blocks: DataFrame, *order) -> DataFrame:
    """``seq`` from 0 in the given order; ties keep the order they had."""
    return blocks.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order, "seq")) - 1).cast("int"))


def y_sort(blocks: DataFrame) -> DataFrame:
    return _renumbered(blocks, "page", "y0", "x0")


def _widest_gap(starts, ends) -> float | None:
    """The middle of the widest strict gap between intervals; the first of equal ones; None at 0.0."""
    best, at, reach = 0.0, None, None
    for a, b in sorted(zip(starts, ends, strict=True), key=lambda p: p[0]):
        if reach is not None and a > reach and a - reach > best:
            best, at = a - reach, reach + (a - reach) / 2
        reach = b if reach is None else max(reach, b)
    return at or None


def _cut(boxes: list[tuple]) -> list[int]:
    """Row numbers of boxes (row, x0, y0, x1, y1) in reading order, along a stack of parts to do."""
    out, todo = [], [boxes]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            if (y := _widest_gap([b[2] for b in part], [b[4] for b in part])) is not None:
                todo += [[b for b in part if b[2] >= y], [b for b in part if b[4] <= y]]
                continue
            if (x := _widest_gap([b[1] for b in part], [b[3] for b in part])) is not None:
                todo += [[b for b in part if b[1] >= x], [b for b in part if b[3] <= x]]
                continue
        out += [b[0] for b in sorted(part, key=lambda b: (b[2], b[1]))]
    return out


def _cut_pages(names: list[str]):
    """Batches sorted by (doc_id, page, seq), each page's rows in reading order; a page may go on in the next batch."""
    doc, page, seq = (names.index(c) for c in ("doc_id", "page", "seq"))
    box = [names.index(c) for c in ("x0", "y0", "x1", "y1")]

    def ordered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = list(zip(rows.column(doc).to_pylist(), rows.column(page).to_pylist(), strict=True))
        boxes = list(zip(range(len(keys)), *[rows.column(c).to_pylist() for c in box], strict=True))
        order, first = [], 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[first]:
                order += _cut(boxes[first:k])
                first = k
        rows = rows.take(pa.array(order, type=pa.int64()))
        rows = rows.set_column(seq, rows.schema.field(seq), pa.array(range(len(order)), type=pa.int64()).cast(rows.schema.field(seq).type))
        yield from rows.combine_chunks().to_batches()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < _PAGE_ROWS:
                continue
            last = (held.column(doc)[-1], held.column(page)[-1])
            n = len(held)
            while n and (held.column(doc)[n - 1], held.column(page)[n - 1]) == last:
                n -= 1
            if n:
                yield from ordered(held.slice(0, n))
                held = held.slice(n)
        if held is not None and len(held):
            yield from ordered(held)

    return cut


def xy_cut(blocks: DataFrame) -> DataFrame:
    """Pages cut at their widest gaps, first across and then down, as long as there are gaps.

    Many pages stream through one function; what it holds is bounded by the largest page's blocks.
    """
    rows = blocks.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq")
    return _renumbered(map_arrow(rows, _cut_pages(blocks.columns), blocks.schema), "page")


def side_blocks_last(blocks: DataFrame) -> DataFrame:
    """On each page the main column first, then narrow blocks beside it; both by position.

    The main column's edges are upper medians over wide blocks (all blocks if none is wide).
    """
    page = Window.partitionBy("doc_id", "page")
    width = F.max("x1").over(page) - F.min("x0").over(page)
    rows = blocks.withColumns({"_w": width, "_n": F.count("*").over(page)})
    share = F.when(F.col("_w") > 0, (F.col("x1") - F.col("x0")) / F.col("_w"))
    rows = rows.withColumn("_share", share).withColumn("_wide", F.coalesce(F.col("_share") >= WIDE, F.lit(False)))
    rows = rows.withColumn("_main", F.col("_wide") | ~F.max("_wide").over(page))
    main = Window.partitionBy("doc_id", "page", "_main")
    middle = F.floor(F.count("*").over(main) / 2) + 1
    rows = rows.withColumns({f"_{c}": F.when(F.col("_main") & (F.row_number().over(main.orderBy(c)) == middle), F.col(c)) for c in ("x0", "x1")})
    rows = rows.withColumns({"_left": F.max("_x0").over(page), "_right": F.max("_x1").over(page)})
    outside = (F.col("x1") < F.col("_left")) | (F.col("x0") > F.col("_right"))
    side = (F.col("_n") >= LEAST_BLOCKS) & (F.col("_w") > 0) & (F.col("_share") < NARROW) & outside
    rows = rows.withColumn("_side", F.coalesce(side, F.lit(False)))
    return _renumbered(rows, "page", "_side", "y0", "x0").drop("_w", "_n", "_share", "_wide", "_main", "_x0", "_x1", "_left", "_right", "_side")


#: Sorters by name; others may be added.
SORTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"y_sort": y_sort, "xy_cut": xy_cut, "column_based": xy_cut}


def order_blocks(blocks: DataFrame, strategy: str = "y_sort") -> DataFrame:
    """The named sorter (by position if there is none), then side blocks last; ``confidence`` is always 1."""
    return side_blocks_last(SORTERS.get(strategy, y_sort)(blocks)).withColumn("confidence", F.lit(1.0))


def number_images(images: DataFrame) -> DataFrame:
    """Images (doc_id, image_no, page, x0, y0, …) with sequence 1..n by position, and their anchors; a missing box is at 0."""
    at = [F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0))]
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", *at, "image_no"))
    return images.withColumn("image_seq", seq).withColumn("anchor", F.concat(F.lit("img-"), F.col("image_seq")))


def interleave(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Text and images of a chapter in one order (page, y0, x0, text first): doc_id, chapter_id, kind, place, ref."""
    text = blocks.select("doc_id", "chapter_id", F.lit("text").alias("kind"), "page", "y0", "x0", F.col("seq").alias("ref"))
    at = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("y0", "x0")]
    image = images.select("doc_id", "chapter_id", F.lit("image").alias("kind"), "page", *at, F.col("image_seq").alias("ref"))
    order = Window.partitionBy("doc_id", "chapter_id").orderBy("page", "y0", "x0", F.col("kind") == "image", "ref")
    return text.unionByName(image).withColumn("place", F.row_number().over(order))
