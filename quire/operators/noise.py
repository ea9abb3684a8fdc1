"""Page noise: repeated lines, headers and footers, excluded pages and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import SPACE, strip

SAMPLE_PAGES, SHARE, LEAST_PAGES, LEAST_LENGTH = 100, 0.2, 2, 10
TOP, BOTTOM, LARGE = 0.08, 0.92, 1.2


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, pattern, n_pages, first_seq) of lines (doc_id, seq, page, text) that stand on many pages.

    Digit runs count as ``#``. Only the first pages are sampled; documents of one page have none.
    """
    some = lines.where(F.col("page") <= SAMPLE_PAGES)
    pages = some.groupBy("doc_id").agg(F.count_distinct("page").alias("sampled"))
    long = some.withColumn("line", strip(F.col("text"))).where(F.length("line") >= LEAST_LENGTH)
    per = long.groupBy("doc_id", F.regexp_replace("line", r"(?U)\d+", "#").alias("pattern")).agg(F.count_distinct("page").alias("n_pages"), F.min("seq").alias("first_seq"))
    many = F.col("n_pages") >= F.greatest(F.lit(float(LEAST_PAGES)), SHARE * F.col("sampled"))
    return per.join(pages, "doc_id").where((F.col("sampled") >= 2) & many).select("doc_id", "pattern", "n_pages", "first_seq")


def strip_repeated(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """``df`` without what matches its document's patterns, in the order in which they were found.

    A line that holds none of them as text, digit runs as ``#``, has no match, and no pattern is compiled for it.
    """
    escaped = F.replace(F.regexp_replace("pattern", r"([\\.\[\]{}()*+?^$|&\-~])", r"\\$1"), F.lit("#"), F.lit("\\d+"))
    per = patterns.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_seq", escaped.alias("p"), "pattern"))).alias("_patterns"))
    rows = df.join(per, "doc_id", "left").withColumn("_plain", F.when(F.col("_patterns").isNotNull(), F.regexp_replace("text", r"(?U)\d+", "#")))
    some = F.filter("_patterns", lambda x: F.contains(F.col("_plain"), x["pattern"]))
    stripped = F.aggregate(F.transform("_patterns", lambda x: x["p"]), F.col("text"), lambda t, p: F.regexp_replace(t, p, F.lit("")))
    return rows.withColumn("text", F.when(F.size(some) > 0, stripped).otherwise(F.col("text"))).drop("_patterns", "_plain")


def at_page_edge(y0: Column, y1: Column, height: Column) -> Column:
    return (height > 0) & ((y1 <= height * TOP) | (y0 >= height * BOTTOM))


def looks_like_header(text: Column) -> Column:
    """Numbers and signs only, many digits, or mostly capitals."""
    t = strip(text)
    n = F.greatest(F.length(t), F.lit(1))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    upper = F.when(letters > 0, F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1))).otherwise(0.0)
    digits = F.regexp_count(t, F.lit(r"(?U)\d"))
    words = F.size(F.split(t, rf"{SPACE}+"))
    capitals = (upper >= 0.75) & (n <= 80)
    numbered = (digits > 0) & (((digits / n >= 0.3) & (words <= 8)) | ((upper >= 0.6) & (words <= 10)))
    return (t != "") & (t.rlike(r"(?U)^[\d\W]+$") | numbered | capitals)


def is_header_footer(text: Column, y0: Column, y1: Column, height: Column, size: Column, body: Column) -> Column:
    """At the page's edge, not much larger than the body (if that is known), and of such a look."""
    large = F.coalesce((body != 0) & (size >= body * LARGE), F.lit(False))
    return at_page_edge(y0, y1, height) & ~large & looks_like_header(text)


def body_size(blocks: DataFrame) -> DataFrame:
    """(doc_id, body_size): the size with most text on the sampled pages; null for documents of one page."""
    some = blocks.where(F.col("page") <= SAMPLE_PAGES)
    per = some.groupBy("doc_id", F.round("font_size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min("seq").alias("first"))
    best = per.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("size"))
    pages = some.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    return best.join(pages, "doc_id").select("doc_id", F.when(F.col("pages") >= 2, F.col("size")).alias("body_size"))


def keep_pages(blocks: DataFrame, start: int | None = None, end: int | None = None, skip: tuple[int, ...] = ()) -> DataFrame:
    """Blocks of the given pages; negative numbers count from the document's end."""
    total = F.max("page").over(Window.partitionBy("doc_id"))
    rows = blocks.withColumn("_pages", total)

    def absolute(n: int) -> Column:
        return F.lit(n) if n >= 0 else F.col("_pages") + 1 + n

    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("page") >= absolute(start))
    if end is not None:
        keep = keep & (F.col("page") <= absolute(end))
    for n in skip:
        keep = keep & (F.col("page") != absolute(n))
    return rows.where(keep).drop("_pages")


def drop_regions(blocks: DataFrame, height: Column, top: float = 0.0, bottom: float = 1.0) -> DataFrame:
    """Blocks that don't lie in the top or bottom share of their page."""
    return blocks.where((F.col("y1") > height * top) & (F.col("y0") < height * bottom))


def drop_margins(blocks: DataFrame, width: Column, left: float = 0.0, right: float = 1.0) -> DataFrame:
    """Blocks that don't lie in the left or right share of their page."""
    return blocks.where((F.col("x1") > width * left) & (F.col("x0") < width * right))
