"""Note references: patterns, positions, hyperlinks, and notes as HTML."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import escape_html, strip
from quire.runtime import ship

#: Patterns by name, in the order in which a style is looked for; fixed values. More may be added.
PATTERNS = {
    "bracket": r"\[(\d{1,2})\]",
    "paren": r"\((\d{1,2})\)",
    "period": r"(?<=\w)\.(\d{1,2})(?=\s|$|[,;:!?])",
    "superscript": r"(?<=[a-zA-Z])(\d{1,2})(?=\s|$|[.,;:!?])",
    "spaced": r"""(?<=[.!?;:\)\]”"’'])[\t ]+(\d{1,2})(?=(?:[\t ]{2,}|$|[\t ]*[,.;:!?…]))""",
    "spaced_closer": r"(?<=\w)[\t ]+(\d{1,2})(?=[\t ]*[\]\)])",
    "keyword": r"(?i)\b(?:endnotes?|notes?)\s+(\d{1,2})\b",
}
DEFAULT = ("bracket", "paren", "spaced", "spaced_closer", "keyword")
#: Of these only the number is replaced, not what stands around it.
NUMBER_ONLY = frozenset({"spaced", "spaced_closer", "keyword"})
NOTE = r"(?sU)^(\d{1,3})[.)]?\s+(.*)$"
REF = "struct<num:int,text:string,start:int,end:int>"


def find(text: str | None, compiled: list[tuple[re.Pattern, int]]) -> list[tuple[int, str, int, int]]:
    """(number, text, start, end) of all references from 1 to 99; where several start, the first pattern's."""
    found: dict[int, tuple[int, str, int, int]] = {}
    for pattern, group in compiled:
        for m in pattern.finditer(text or ""):
            if 1 <= int(m[1]) <= 99:
                found.setdefault(m.start(group), (int(m[1]), m[group], m.start(group), m.end(group)))
    return [found[k] for k in sorted(found)]


def _compiled(names: Iterable[str]) -> list[tuple[re.Pattern, int]]:
    return [(re.compile(PATTERNS[n]), int(n in NUMBER_ONLY)) for n in names if n in PATTERNS]


def references(df: DataFrame, text: str = "text", names: Iterable[str] = DEFAULT, out: str = "refs") -> DataFrame:
    """``df`` with an array of references; unknown pattern names are ignored.

    Offsets need Python; texts without a digit don't go there.
    """
    ship(df.sparkSession)
    names = tuple(names)

    @F.pandas_udf(f"array<{REF}>")
    def refs(texts: pd.Series) -> pd.Series:
        compiled = _compiled(names)
        return texts.map(lambda t: [dict(zip(("num", "text", "start", "end"), r, strict=True)) for r in find(t, compiled)])

    return df.withColumn(out, F.coalesce(refs(F.when(F.col(text).rlike(r"(?U)\d"), F.col(text))), F.array().cast(f"array<{REF}>")))


def tag(blocks: DataFrame, names: Iterable[str] = DEFAULT) -> DataFrame:
    """References of body blocks and list items; null elsewhere and where there are none."""
    rows = references(blocks, "text", names, "footnote_refs")
    some = F.col("role").isin("body", "list-item") & (F.size("footnote_refs") > 0)
    return rows.withColumn("footnote_refs", F.when(some, F.col("footnote_refs")))


def numbers(text: Column, names: Iterable[str] = ("bracket", "paren")) -> Column:
    """Numbers of patterns that need no offsets, by built-in functions, in the order of the patterns."""
    every = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(PATTERNS[n]), F.lit(1)) for n in names]))
    return F.filter(F.transform(every, lambda x: x.cast("int")), lambda n: n.between(1, 99))


# The markup of links, notes and links back is part of the contract; fixed values.
def link(df: DataFrame, text: str, notes_file: Column, names: Iterable[str] = DEFAULT, out: str | None = None) -> DataFrame:
    """``text`` with its references as hyperlinks into ``notes_file``; unchanged where that is null."""
    rows = references(df, text, names, "_refs")

    def put(acc: Column, r: Column) -> Column:
        target = F.concat(F.lit('<a href="'), notes_file, F.lit("#note"), r["num"], F.lit('" class="footnote-ref"><sup>'), r["num"], F.lit("</sup></a>"))
        return F.concat(F.substring(acc, F.lit(1), r["start"]), target, F.substring(acc, r["end"] + 1, F.length(acc)))

    linked = F.aggregate(F.reverse("_refs"), F.col(text), put)
    return rows.withColumn(out or text, F.when(notes_file.isNull(), F.col(text)).otherwise(linked)).drop("_refs")


def style(text: Column) -> Column:
    """The first pattern that matches at all, or null."""
    return F.coalesce(*[F.when(text.rlike(p if n == "keyword" else f"(?U){p}"), n) for n, p in PATTERNS.items()])


def note_html(text: Column, num: Column, back_to: str | None = None) -> Column:
    """A note as a paragraph with an anchor; without a number a plain one. ``back_to`` adds a link back into that file."""
    t = strip(text)
    parsed = t.rlike(NOTE)
    n = F.coalesce(num, F.when(parsed, F.regexp_extract(t, NOTE, 1).try_cast("int")))
    content = F.when(parsed, strip(F.regexp_extract(t, NOTE, 2))).otherwise(t)
    back = F.lit("")
    if back_to:
        back = F.concat(F.lit(f'<a href="{back_to}#ref'), n, F.lit('" class="endnote-backlink" title="Go back"> [^]</a>'))
    anchored = F.concat(F.lit('    <p class="endnote" id="note'), n, F.lit('"><span class="endnote-num">'), n, F.lit(".</span> "), escape_html(content), back, F.lit("</p>"))
    return F.when(n.isNull(), F.concat(F.lit('    <p class="endnote">'), escape_html(t), F.lit("</p>"))).otherwise(anchored)


def notes_html(notes: DataFrame, back_to: str | None = None) -> DataFrame:
    """(doc_id, html) of notes (doc_id, seq, endnote_num, text), in order."""
    rows = notes.withColumn("h", note_html(F.col("text"), F.col("endnote_num"), back_to))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"])
    return rows.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("html"))


def note_numbers(notes: DataFrame) -> DataFrame:
    return notes.where("endnote_num IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list("endnote_num")).alias("numbers"))


def link_stats(rendered: DataFrame) -> DataFrame:
    """(doc_id, n_notes, n_links, n_linked, n_missing) of rendered chapters (doc_id, chapter_no, html).

    The notes are the first chapter with note anchors; links from others count if their note is there.
    """
    is_notes = F.col("html").contains('id="note1"') | F.col("html").contains('class="endnote"')
    home = rendered.where(is_notes).groupBy("doc_id").agg(F.min("chapter_no").alias("notes_no"))
    rows = rendered.join(home, "doc_id")


    def found(pattern: str) -> Column:
        return F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).cast("array<int>")).alias("num")

    notes = rows.where("chapter_no = notes_no").select("doc_id", found(r'id="note(\d{1,3})"')).distinct()
    links = rows.where("chapter_no <> notes_no").select("doc_id", found(r'href="[^"]*#note(\d{1,3})"')).groupBy("doc_id", "num").agg(F.count("*").alias("links"))
    both = notes.join(links, ["doc_id", "num"], "left").groupBy("doc_id")
    return both.agg(
        F.count("*").alias("n_notes"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        F.count("links").alias("n_linked"),
        F.sum(F.col("links").isNull().cast("long")).alias("n_missing"),
    )
