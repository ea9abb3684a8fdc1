"""Roles of blocks: headings by score and style, list items, note starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import SPACE, is_upper, strip
from quire.operators.styles import LARGER, with_styles
from quire.sources.blocks import is_bold

H1, H2, H3 = 80.0, 65.0, 50.0
LINE, CLEAR, WIDER = 1.2, 1.5, 1.5
#: Patterns of the contract; fixed values.
PART = r"(?iU)^(Part|Chapter)\s+([IVXLC]+|\d+)\b"
NOTE = r"(?U)^(\d{1,2})[\s\x1c-\x1f]{2,}"
NUMBERED = r"(?U)^\d+\.[\s\x1c-\x1f]"


def _last(text: Column) -> Column:
    return F.substring(text, -1, 1)


def looks_like_continuation(text: Column) -> Column:
    """Starts in lower case, or has a comma or an inner full stop and no end mark."""
    inner = F.substring(text, F.lit(1), F.length(text) - 1)
    open_end = (F.contains(text, F.lit(",")) | F.contains(inner, F.lit("."))) & ~_last(text).isin(*".:;?!")
    return (text != "") & (text.rlike(r"(?U)^\p{Ll}") | open_end)


def is_list_item(text: Column) -> Column:
    t = strip(text)
    return t.startswith("•") | t.startswith("- ") | t.rlike(NUMBERED)


def note_number(text: Column, size: Column, body: Column) -> Column:
    """1 to 99 where a block starts like a note and isn't larger than the body; else null."""
    n = F.try_to_number(F.nullif(F.regexp_extract(strip(text), NOTE, 1), F.lit("")), F.lit("99")).cast("int")
    return F.when(n.between(1, 99) & (size <= body + 0.5), n)


def heading_scores(blocks: DataFrame, larger: float = LARGER) -> DataFrame:
    """``blocks`` with body_size, body_flags, style_role, score and signals; gaps count on the same page only."""
    rows = with_styles(blocks, larger)
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = rows.withColumns({f"_{side}_{c}": f(c).over(order) for side, f in (("prev", F.lag), ("next", F.lead)) for c in ("page", "y0", "y1")})
    text, size, body = strip(F.col("text")), F.col("font_size"), F.col("body_size")
    # At a document's edges the neighbour is the block itself.
    above = F.when(F.col("_prev_page").isNull(), F.col("y0") - F.col("y1")).when(F.col("_prev_page") == F.col("page"), F.col("y0") - F.col("_prev_y1")).otherwise(0.0)
    below = F.when(F.col("_next_page").isNull(), F.col("y0") - F.col("y1")).when(F.col("_next_page") == F.col("page"), F.col("_next_y0") - F.col("y1")).otherwise(0.0)
    rows = rows.withColumns({"_t": text, "_above": above, "_below": below})
    t, diff = F.col("_t"), size - body
    carried = looks_like_continuation(t)
    wide = F.col("_above") > body * LINE * CLEAR
    wider = (F.col("_above") > F.col("_below") * WIDER) & (F.col("_below") > 0)
    tests = [
        (is_bold(F.col("flags")) & ~is_bold(F.col("body_flags")), F.lit(30.0), F.lit("Bold")),
        (diff > 0.5, diff * 10, F.format_string("Size+%.1f", diff)),
        (~_last(t).isin(*".:;?!,"), F.lit(20.0), F.lit("NoPunct")),
        (F.length(t) < 150, F.lit(10.0), F.lit("Short")),
        (F.length(t) < 50, F.lit(5.0), F.lit(None).cast("string")),
        (is_upper(t) & (F.length(t) > 4), F.lit(10.0), F.lit("ALLCAPS")),
        (wide & ~carried, F.lit(10.0), F.lit("TopMargin")),
        (wider & ~carried, F.lit(15.0), F.lit("Top>Bottom")),
    ]
    score = sum((F.when(c, p).otherwise(0.0) for c, p, _ in tests), F.lit(0.0))
    signals = F.filter(F.array(*[F.when(c, s) for c, _, s in tests]), lambda s: s.isNotNull())
    rows = rows.withColumn("score", F.when(t == "", 0.0).otherwise(score)).withColumn("signals", F.when(t == "", F.array().cast("array<string>")).otherwise(signals))
    return rows.drop("_t", "_above", "_below", *[f"_{s}_{c}" for s in ("prev", "next") for c in ("page", "y0", "y1")])


def classify(blocks: DataFrame, larger: float = LARGER) -> DataFrame:
    """``blocks`` with body_size, body_flags, score, signals, role and endnote_num."""
    rows = heading_scores(blocks, larger)
    score, diff, bold = F.col("score"), F.col("font_size") - F.col("body_size"), is_bold(F.col("flags"))
    role = F.when(score >= H1, "h1").when(score >= H2, "h2").when(score >= H3, "h3").otherwise("body")
    rows = rows.withColumn("role", role)
    rows = rows.withColumn("role", F.when(F.col("style_role") == "h1", "h1").when((F.col("style_role") == "h2") & (F.col("role") == "body"), "h2").otherwise(F.col("role")))
    near = F.col("role").startswith("h") & (diff <= 0.3)
    rows = rows.withColumn("role", F.when(near & ~bold, "body").when(near & bold, "h3").otherwise(F.col("role")))
    part = strip(F.col("text")).rlike(PART) & bold & (diff >= 0.5)
    rows = rows.withColumn("role", F.when(part, "h1").otherwise(F.col("role")))
    rows = rows.withColumn("role", F.when((F.col("role") == "body") & is_list_item(F.col("text")), "list-item").otherwise(F.col("role")))
    rows = rows.withColumn("endnote_num", note_number(F.col("text"), F.col("font_size"), F.col("body_size")))
    rows = rows.withColumn("role", F.when((F.col("role") == "body") & F.col("endnote_num").isNotNull(), "endnote").otherwise(F.col("role")))
    return rows.drop("style_role")


def is_heading(role: Column) -> Column:
    return role.rlike(r"^h[0-9]+$")
