"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Within a source, documents stand in the order (size class, hash of the id). Each is expected
``rate = target / source_size`` times; the prefix sum of that is ``rate * rank``. One random
offset is added, and a document is emitted once per integer boundary that its step crosses.
Ordering by size class spreads the emitted copies evenly over sizes, so the words taken stay
near the target.

The rank comes from counts, not from one window over a source: (source, size class) is split
into ranges of the hash with about ``bucket_rows`` rows, ranges are counted, counts are summed
up in two small windows, and rows are numbered within their range. A source with a third of
all rows, or a third of all rows of one size, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpointed

SPACED_WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
SEED = "quire-mix"
BUCKET_ROWS = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def _uniform32(text: Column) -> Column:
    """32 hash bits of a text, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per source: key, source_size, target, rate, offset.

    ``sizes`` has source and size. Sources by code point, null last, get the weights in turn.
    They share ``budget`` times all sizes; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight. A source of size 0 gets target and rate 0.
    The windows without partition hold one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", F.array(*[F.lit(float(w)) for w in weights])[turn % len(weights)])
    per = per.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*",
        (F.sum("source_size").over(all_rows) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left_words"),
        (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("left_w"),
    ).withColumn("level", F.col("left_words") / F.col("left_w"))
    per = per.withColumn("open_level", F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level")))
    first_open = F.first("open_level", ignorenulls=True).over(all_rows)
    target = F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), first_open * F.col("w")))
    return per.withColumn("target", target).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        (_uniform32(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))) / F.lit(2.0**32)).alias("offset"),
    )


def _drawn(sizes: DataFrame, weights: Sequence[int], budget: float, most: float, seed: str, bucket_rows: int) -> DataFrame:
    """``sizes`` (doc_id, source, size, tie, row), read twice, with source_size, target, rate, n_copies."""
    bits = F.length(F.bin("size"))
    rows = sizes.select(
        "*",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
        (bits * 8 + F.floor(F.col("size") * 8 / F.pow(F.lit(2.0), bits - 1))).cast("int").alias("cls"),
        _uniform32(F.concat(F.lit(seed + "#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    )
    classes = rows.groupBy("key", "cls").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("key").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(
        "key", "cls", F.coalesce(F.sum("n").over(by_class), F.lit(0)).alias("class_base"), F.ceil(F.col("n") / bucket_rows).alias("n_ranges")
    )
    per = targets(sizes, weights, budget, most, seed).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    # One join brings all that a row needs of its class and source; a class with many rows is split there as a
    # skewed join, since its rows are dealt out anew, by ranges, behind it.
    ranged = rows.join(classes.join(per, "key"), ["key", "cls"]).withColumn("rng", F.floor(F.col("h") * F.col("n_ranges") / F.lit(2.0**32)).cast("long"))
    ranged = ranged.repartition("key", "cls", "rng")
    ranges = ranged.groupBy("key", "cls", "rng").agg(F.count("*").alias("n"))
    by_range = Window.partitionBy("key", "cls").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("key", "cls", "rng", F.coalesce(F.sum("n").over(by_range), F.lit(0)).alias("range_base"))
    within = Window.partitionBy("key", "cls", "rng").orderBy("h", "doc_id", "tie", "row")
    numbered = ranged.join(ranges, ["key", "cls", "rng"]).withColumn("within", F.row_number().over(within))
    rank = F.col("class_base") + F.col("range_base") + F.col("within")
    step = F.floor(F.col("rate") * rank + F.col("offset")) - F.floor(F.col("rate") * (rank - 1) + F.col("offset"))
    return numbered.withColumn("n_copies", step.cast("int"))


def _size_and_tie() -> list[Column]:
    """A row's size, and a hash that puts rows of equal ids but different texts in an order of their own."""
    return [word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")]


def copies(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: str = SEED, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, n_copies, taken.

    Null text has size 0; null source is a source of its own; null or repeated doc_ids are
    rows like any others, in the order of a hash of their texts (rows equal in that too may swap
    their places, the rows of the result don't change). Texts of any length count whole. An empty
    table gives an empty result. Other columns are ignored.
    """
    sizes = checkpointed(documents.select("doc_id", "source", *_size_and_tie(), F.lit(0).alias("row")))  # two passes follow, and neither reads a text again
    return _drawn(sizes, weights, budget, most, seed, bucket_rows).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "n_copies", (F.col("n_copies") * F.col("size")).alias("taken")
    )


def op10_mix_sources(documents: DataFrame) -> DataFrame:
    """The mix of ``documents`` under the production weights: what it takes of each document."""
    return copies(documents).select("doc_id", "size", "source_size", "target", "taken", "n_copies")


def mixed(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: str = SEED, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The mix itself: all columns of ``documents``, each row as often as it was drawn, and copy_no from 1.

    Rows are drawn one by one, as ``copies`` has it for nulls, ties and repeated rows. A column
    named copy_no of ``documents`` is replaced; others may have any names. Rows are written once,
    numbered, and shuffled once, by their number, without a sort; sizes are counted once.
    """
    columns = [c for c in documents.columns if c.lower() != "copy_no"]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole")
    rows = checkpointed(documents.select(whole, "doc_id", "source", *_size_and_tie(), F.monotonically_increasing_id().alias("row")))
    drawn = _drawn(rows.drop("whole"), weights, budget, most, seed, bucket_rows).where("n_copies > 0").select("row", "n_copies")
    taken = rows.select("row", "whole").join(drawn.hint("shuffle_hash"), "row")
    return taken.select("whole.*", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))


ORACLE_SQL = f"""
WITH s AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s GROUP BY source
), w AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM p
), l AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w
), o AS (
  SELECT arg_min(level, cap / w) AS level FROM l WHERE cap / w > level
), t AS (
  SELECT source, source_size, CASE WHEN l.cap / l.w > l.level THEN least(l.cap, (SELECT level FROM o) * l.w) ELSE l.cap END AS target,
    ('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS offs FROM l
), b AS (
  SELECT *, CASE WHEN size = 0 THEN 1 ELSE length(bin(size)) END AS bits, ('0x' || substr(md5('{SEED}#' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM s
), r AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.offs, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY b.source ORDER BY bits * 8 + (b.size * 8) // (1::BIGINT << (bits - 1)), h, b.doc_id) AS rnk
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, n_copies * size::BIGINT AS taken, n_copies
FROM (SELECT *, (floor(rate * rnk + offs) - floor(rate * (rnk - 1) + offs))::INT AS n_copies FROM r)
"""
