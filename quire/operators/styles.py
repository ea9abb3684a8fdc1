"""Font styles: how much text each has, the body style, roles, and a layout profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.sources.blocks import is_bold

LARGER, SMALLER, DEEPEST = 1.2, 0.9, 6
DEFAULT_SIZE, DEFAULT_FLAGS = 11.0, 0
MOST_SAMPLES, LEAST_TEXT, CLUSTER = 5, 20, 50
STYLE = ["doc_id", "font_name", "size", "flags"]


def histogram(blocks: DataFrame) -> DataFrame:
    """(doc_id, font_name, size, flags, n_chars, first_seq); sizes to one decimal."""
    n = F.sum(F.length(strip(F.col("text")))).alias("n_chars")
    return blocks.groupBy("doc_id", "font_name", F.round("font_size", 1).alias("size"), "flags").agg(n, F.min("seq").alias("first_seq"))


def body_style(blocks: DataFrame) -> DataFrame:
    """(doc_id, body_font, body_size, body_flags): the style with most text, the first on a tie."""
    most = F.max_by(F.struct("font_name", "size", "flags"), F.struct("n_chars", -F.col("first_seq"))).alias("s")
    per = histogram(blocks).groupBy("doc_id").agg(most)
    return per.select("doc_id", F.col("s.font_name").alias("body_font"), F.col("s.size").alias("body_size"), F.col("s.flags").alias("body_flags"))


def _role(rows: DataFrame, larger: float = LARGER) -> DataFrame:
    """``rows`` (style, n_chars, first_seq, body) with style_role; rows of one style may be many."""
    is_body = (F.col("font_name").eqNullSafe(F.col("body_font"))) & (F.col("size") == F.col("body_size")) & (F.col("flags") == F.col("body_flags"))
    kind = (
        F.when(is_body, "body")
        .when(F.col("size") > F.col("body_size") * larger, "header")
        .when(F.col("size") < F.col("body_size") * SMALLER, "footnote_or_small")
        .when(is_bold(F.col("flags")), "strong")
        .otherwise("body_variant")
    )
    level = F.dense_rank().over(Window.partitionBy("doc_id", "_kind").orderBy(F.col("size").desc(), "first_seq"))
    rows = rows.withColumn("_kind", kind).withColumn("_level", F.least(level, F.lit(DEEPEST)))
    return rows.withColumn("style_role", F.when(F.col("_kind") == "header", F.concat(F.lit("h"), F.col("_level"))).otherwise(F.col("_kind"))).drop("_kind", "_level")


def roles(blocks: DataFrame) -> DataFrame:
    """The histogram with a role per style: body, h1 to h6 by falling size, footnote_or_small, strong, body_variant.

    Each header style has a level of its own, equal sizes by what comes first.
    """
    rows = histogram(blocks)
    most = F.max(F.struct("n_chars", -F.col("first_seq"), "font_name", "size", "flags")).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_b", most).withColumns({f"body_{c}": F.col(f"_b.{n}") for c, n in (("font", "font_name"), ("size", "size"), ("flags", "flags"))})
    return _role(rows).select(*STYLE, "n_chars", "first_seq", "style_role")


def with_styles(blocks: DataFrame, larger: float = LARGER) -> DataFrame:
    """``blocks`` with body_size, body_flags and style_role, by windows: one exchange by doc_id, and no join.

    Styles more than ``larger`` times the body's size are headers. Blocks without a font have the role ``body``.
    """
    rows = blocks.repartition("doc_id").withColumn("size", F.round("font_size", 1))
    style = Window.partitionBy(*STYLE)
    rows = rows.withColumns({"n_chars": F.sum(F.length(strip(F.col("text")))).over(style), "first_seq": F.min("seq").over(style)})
    most = F.max(F.struct("n_chars", -F.col("first_seq"), "font_name", "size", "flags")).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_b", most).withColumns({f"body_{c}": F.col(f"_b.{n}") for c, n in (("font", "font_name"), ("size", "size"), ("flags", "flags"))})
    rows = _role(rows, larger).withColumns(
        {
            "body_size": F.coalesce("body_size", F.lit(DEFAULT_SIZE)),
            "body_flags": F.coalesce("body_flags", F.lit(DEFAULT_FLAGS)),
            "style_role": F.when(F.col("font_name").isNull(), "body").otherwise(F.coalesce("style_role", F.lit("body"))),
        }
    )
    return rows.drop("size", "n_chars", "first_seq", "_b", "body_font")


#: What fills the sample up behind first, middle and last page, as far as it isn't among them.
_FILL = (3, 4, 1, 2)


def sample_pages(n: int) -> list[int]:
    """Up to MOST_SAMPLES of pages 0 to n - 1: all, or first, middle, last and two near the front."""
    if n <= MOST_SAMPLES:
        return list(range(n))
    three = {0, n // 2, n - 1}
    return sorted(three | set([k for k in _FILL if k not in three][: MOST_SAMPLES - 3]))


def profile(blocks: DataFrame) -> DataFrame:
    """One row per document: pages, sampled pages, text layer, columns, body size, suggested strategy.

    Left edges are rounded to multiples of 50; columns are the upper median of their number per
    sampled page, three at most.
    """
    total = blocks.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    n = F.col("page_count")
    three = F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1)
    rest = F.slice(F.array_except(F.array(*map(F.lit, _FILL)), three), 1, MOST_SAMPLES - 3)
    picked = F.when(n <= MOST_SAMPLES, F.sequence(F.lit(0), n - 1)).otherwise(F.array_sort(F.concat(F.array_distinct(three), rest)))
    total = total.withColumn("sampled", F.transform(picked, lambda k: k + 1))
    some = blocks.join(total, "doc_id").where(F.array_contains("sampled", F.col("page")))
    pages = some.groupBy("doc_id", "page").agg(
        F.count_distinct(F.bround(F.col("x0") / CLUSTER) * CLUSTER).alias("clusters"), F.length(strip(F.array_join(F.collect_list("text"), "\n"))).alias("length")
    )
    counts = F.array_sort(F.collect_list("clusters"))
    pages = pages.groupBy("doc_id").agg(F.max((F.col("length") > LEAST_TEXT).cast("int")).alias("has_text"), F.element_at(counts, F.floor(F.size(counts) / 2).cast("int") + 1).alias("median"))
    sizes = some.groupBy("doc_id", F.round("font_size", 1).alias("size")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    sizes = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body_size"), F.count("*").alias("unique_sizes"))
    many = F.col("median") >= 2
    return (
        total.join(pages, "doc_id")
        .join(sizes, "doc_id")
        .select(
            "doc_id",
            "page_count",
            F.size("sampled").alias("n_sampled"),
            (F.col("has_text") == 1).alias("has_text"),
            many.alias("multi_column"),
            F.when(many, F.least("median", F.lit(3))).otherwise(1).cast("int").alias("n_columns"),
            "body_size",
            "unique_sizes",
            F.when(many, "xy_cut").otherwise("y_sort").alias("strategy"),
        )
    )
