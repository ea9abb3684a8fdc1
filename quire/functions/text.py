"""Scalar text functions as columns. Null means empty wherever that is said; all are built-in but NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import ship

#: Whitespace as Python's ``\s`` has it: Java's Unicode class lacks U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Ligatures and what they stand for; fixed values.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE"))
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
MEDIA_TYPES = {"png": "image/png", "jpeg": "image/jpeg", "jpg": "image/jpeg", "gif": "image/gif"}


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def replace_all(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip(text: Column) -> Column:
    """Without whitespace at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Runs of whitespace become a blank, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(or_empty(text), rf"{SPACE}+", " "))


def resolve_ligatures(text: Column) -> Column:
    return replace_all(or_empty(text), LIGATURES)


def remove_hyphenation(text: Column) -> Column:
    """No soft hyphens; a hyphen at a line's end goes with the line break."""
    return F.regexp_replace(F.replace(or_empty(text), F.lit("­"), F.lit("")), rf"-{SPACE}*\n{SPACE}*", "")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(or_empty(text), r"\p{C}", "")


def comparison_form(text: Column) -> Column:
    """Punctuation and hyphenation made alike, for matching across sources."""
    out = F.regexp_replace(or_empty(text), rf"{SPACE}+([,.:;!?])", "$1")
    out = replace_all(out, (("—", "-"), ("–", "-")))
    out = F.regexp_replace(out, rf"(?U)\b(\d{{1,3}})\.{SPACE[4:]}", "$1 ")
    out = F.regexp_replace(out, rf"(?U)(?<=\w)-{SPACE[4:]}+", " ")
    return F.regexp_replace(out, r"(?U)(?<=\w)-(?=\w)", " ")


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility normalisation. ASCII texts don't change and don't leave the JVM."""
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def canonicalize(df: DataFrame, column: str, out: str | None = None, aggressive: bool = False, comparison: bool = False) -> DataFrame:
    """``df`` with the canonical form of a text column, of null the empty text."""
    ship(df.sparkSession)
    text = remove_hyphenation(resolve_ligatures(nfkc(or_empty(F.col(column)))))
    text = strip_controls(text) if aggressive else text
    return df.withColumn(out or column, comparison_form(text) if comparison else text)


def escape_html(text: Column) -> Column:
    return replace_all(or_empty(text), HTML_ESCAPES)


def tokens(text: Column) -> Column:
    """Words of four characters or more."""
    return F.regexp_extract_all(or_empty(text), F.lit(r"(?U)\w{4,}"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(or_empty(text), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def snippet(text: Column, size: int = 160) -> Column:
    return F.substring(F.replace(strip(or_empty(text)), F.lit("\n"), F.lit(" ")), 1, size)


def is_upper(text: Column) -> Column:
    """At least one letter with case, and none in lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def rename_extension(filename: Column, extension: Column) -> Column:
    """Another extension behind the last dot; jpeg becomes jpg."""
    new = F.when(F.lower(extension) == "jpeg", "jpg").otherwise(F.lower(extension))
    return F.concat(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit("."), new)


def media_type(extension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(extension)), F.lit("image/png"))
