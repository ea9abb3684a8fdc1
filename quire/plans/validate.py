"""Validation of pairs of texts, statistics of a conversion, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import word_count
from quire.operators import fidelity

DROP_FROM, DROP_SHARE = 0.5, 0.05


def damaged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, target): documents with a copy whose second half comes first, or that lacks a fifth in the middle.

    Even ids get the one, odd ids the other; a damage that can be told in SQL as well.
    """
    n = F.length("text")
    half, fifth = F.floor(n / 2).cast("int"), F.floor(n / 5).cast("int")
    swapped = F.concat(F.substring("text", half + 1, n), F.lit(" "), F.substring("text", F.lit(1), half))
    cut = F.concat(F.substring("text", F.lit(1), 2 * fifth), F.substring("text", 3 * fifth + 1, n))
    return documents.select("doc_id", F.col("text").alias("source"), F.when(F.col("doc_id") % 2 == 0, swapped).otherwise(cut).alias("target"))


DAMAGED_SQL = """pairs AS (
  SELECT doc_id, text AS source, CASE WHEN doc_id % 2 = 0
    THEN substr(text, length(text) // 2 + 1) || ' ' || substr(text, 1, length(text) // 2)
    ELSE substr(text, 1, 2 * (length(text) // 5)) || substr(text, 3 * (length(text) // 5) + 1) END AS target FROM documents)"""


def truncated(documents: DataFrame, start: float = DROP_FROM, share: float = DROP_SHARE) -> DataFrame:
    """(doc_id, source, target): documents with a copy that lacks a share of the text from some point on."""
    n = F.length("text")
    a = F.floor(n * start).cast("int")
    target = F.concat(F.substring("text", F.lit(1), a), F.substring("text", a + F.floor(n * share).cast("int") + 1, n))
    return documents.select("doc_id", F.col("text").alias("source"), target.alias("target"))


def shuffled(documents: DataFrame, parts: int = 10, seed: int = 42) -> DataFrame:
    """(doc_id, source, target): documents with a copy whose blocks are in another, fixed order."""
    n = F.length("text")
    size = F.ceil(n / parts).cast("int")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(F.xxhash64(F.lit(seed), k).alias("h"), k.alias("k"))))
    target = F.array_join(F.transform(order, lambda x: F.substring(F.col("text"), x["k"] * size + 1, size)), " ")
    return documents.select("doc_id", F.col("text").alias("source"), target.alias("target"))


def validate(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores and verdict per doc_id of ``sources`` (doc_id, text, perhaps error) against ``targets``.

    A side that is missing or has an error gives the status ``error`` and no scores.
    """
    a = sources.select("doc_id", F.col("text").alias("source"), (F.col("error") if "error" in sources.columns else F.lit(None).cast("string")).alias("e1"))
    b = targets.select("doc_id", F.col("text").alias("target"), (F.col("error") if "error" in targets.columns else F.lit(None).cast("string")).alias("e2"))
    both = a.join(b, "doc_id", "full")
    bad = F.coalesce("e1", "e2", F.when(F.col("source").isNull(), "no source"), F.when(F.col("target").isNull(), "no target"))
    both = both.withColumn("error", bad)
    good = fidelity.scores(both.where("error IS NULL").select("doc_id", "source", "target")).withColumn("error", F.lit(None).cast("string"))
    wrong = both.where("error IS NOT NULL").select("doc_id", F.lit("error").alias("status"), "error")
    return good.unionByName(wrong, allowMissingColumns=True)


def images_in(rendered: DataFrame) -> DataFrame:
    """(doc_id, n): the pictures of rendered chapters."""
    return rendered.groupBy("doc_id").agg(F.sum(F.regexp_count("html", F.lit('<figure class="chapter-image"'))).cast("long").alias("n"))


def conversion_stats(sources: DataFrame, targets: DataFrame, chapters: DataFrame, links: DataFrame, found: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """One wide row per document: words and characters of both sides, shares kept, chapters, notes and links, images, scores.

    ``sources`` and ``targets`` have doc_id and text; ``chapters`` and ``links`` are the tables of
    ``structure.chapters`` and ``notes.link_stats``; ``found`` and ``kept`` (doc_id, n) count the
    images of both sides. Documents without a target have zeros.
    """

    def counts(df: DataFrame, side: str) -> DataFrame:
        return df.select("doc_id", word_count(F.col("text")).alias(f"{side}_words"), F.length("text").alias(f"{side}_chars"), F.col("text").alias(side))

    heads = chapters.groupBy("doc_id").agg(F.count("*").alias("headings"), F.sum(F.col("parent_id").isNull().cast("long")).alias("chapters"))
    notes = chapters.where("is_endnotes").groupBy("doc_id").agg(F.sum("n_blocks").alias("notes"))
    both = counts(sources, "source").join(counts(targets, "target"), "doc_id", "left")
    scores = fidelity.scores(both.where("target IS NOT NULL").select("doc_id", "source", "target")).select("doc_id", "completeness", "order_score")
    rows = both.drop("source", "target")
    pictures = [df.select("doc_id", F.col("n").cast("long").alias(name)) for df, name in ((found, "source_images"), (kept, "target_images")) if df is not None]
    for part in (heads, notes, links, scores, *pictures):
        rows = rows.join(part, "doc_id", "left")
    rows = rows.withColumns({name: F.lit(0).cast("long") for name in ("source_images", "target_images") if name not in rows.columns})
    rows = rows.na.fill(0)
    for unit in ("words", "chars"):
        kept = F.when(F.col(f"source_{unit}") > 0, F.col(f"target_{unit}") * 100.0 / F.greatest(f"source_{unit}", F.lit(1))).otherwise(0.0)
        rows = rows.withColumn(f"{unit}_kept", kept)
    return rows


def tenths(x: Column) -> Column:
    """``x``, 0 or more, to one decimal by its exact binary value, ties to even, as C's printf has it.

    ``bround`` and Java's formats round the shortest decimal: 0.05, which is a bit more than that,
    becomes 0.0. Here 16 x + 4 x = 20 x comes as a sum and the exact rest that its rounding left;
    the rest decides where the sum is an odd whole number, the middle between two tenths.
    """
    a, b = x * 16, x * 4
    total = a + b
    rest = b - (total - a)
    whole = F.floor(total)
    above = F.floor((whole + 1) / 2)
    down = (total == whole) & (whole % 2 == 1) & ((rest < 0) | ((rest == 0) & (above % 2 == 1)))
    return F.when(down, above - 1).otherwise(above) / 10.0


def summary_text(stats: DataFrame) -> DataFrame:
    """(doc_id, report): statistics as lines of text, an alert for notes without links, and a verdict; all images must be there."""
    passed = (F.col("completeness") >= fidelity.PASS_COMPLETENESS) & (F.col("order_score") >= fidelity.PASS_ORDER) & (F.col("target_images") >= F.col("source_images"))
    line = F.format_string(
        "Words: %s of %s (%.1f%%)\nChapters: %d, headings: %d, notes: %d\nImages: %d of %d\nCompleteness: %.1f%%, order: %.1f%%\n%s%s",
        F.format_number("target_words", 0),
        F.format_number("source_words", 0),
        tenths(F.col("words_kept")),
        "chapters",
        "headings",
        "notes",
        "target_images",
        "source_images",
        tenths(F.col("completeness")),
        tenths(F.col("order_score")),
        F.when(F.col("n_linked") < F.col("n_notes"), F.format_string("ALERT: %d of %d notes are linked\n", "n_linked", "n_notes")).otherwise(""),
        F.when(passed, "PASS").otherwise("NEEDS REVIEW"),
    )
    return stats.select("doc_id", line.alias("report"))
