"""How completely, and in what order, a source text survives in a target text.

The source is cut into overlapping chunks; each is looked for in the target from a cursor on,
exactly and then by its words; the share found is the completeness, and the longest increasing
run of positions is the order. The search needs places in long texts, which strings in the JVM
count from their start, so it is done over Arrow batches, in time that grows with the texts. A
document's texts stay in one row, and nothing is shuffled.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import comparison_form, normalize_whitespace, snippet, strip, tokens
from quire.runtime import map_arrow, ship

CHUNK, OVERLAP = 600, 100
WINDOW = 10_000
FUZZY, RECONCILE = 0.85, 0.98
SIGNIFICANT = 20
PASS_COMPLETENESS, PASS_ORDER = 95.0, 80.0

_CHUNK = "struct<chunk_no:int,start_index:int,end_index:int,text:string,is_partial:boolean>"


#: Chunks of a block, which is cut out of the text first.
_BLOCK = 64
#: Targets from this length on get an index of what they hold, so that a miss needs no search.
_LONG, _GRAM, _GRAMS = 1 << 13, 16, (4, 6, 8)
_WORD = re.compile(r"\w{4,}")
_FOUND = pa.struct([("chunk", pa.struct([("chunk_no", pa.int32()), ("start_index", pa.int32()), ("end_index", pa.int32()), ("text", pa.string()), ("is_partial", pa.bool_())])), ("pos", pa.int32()), ("kind", pa.string())])
#: Rows that go on at once.
_ROWS = 256


def _let(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.transform(F.array(value), body)[0]


def _step(size: int, overlap: int) -> int:
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    return size - overlap


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Array of chunks of the whitespace-normalised text; offsets from 0, the last chunk ends at the text's end.

    Empty and null texts have none. Raises ValueError if the overlap isn't smaller than the size.
    A text is cut into blocks of chunks first, since a place in a text is found by counting from its start.
    """
    step = _step(size, overlap)

    def cut(t: Column) -> Column:
        n = F.length(t)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")

        def block(b: Column) -> Column:
            part = F.substring(t, b * (_BLOCK * step) + 1, F.lit(_BLOCK * step + overlap))

            def one(p: Column, j: Column) -> Column:
                k = b * _BLOCK + j
                return F.struct(
                    k.alias("chunk_no"), (k * step).alias("start_index"), F.least(k * step + size, n).alias("end_index"), F.substring(p, j * step + 1, F.lit(size)).alias("text"), (n - k * step < size).alias("is_partial")
                )

            return _let(part, lambda p: F.transform(F.sequence(F.lit(0), F.least(F.lit(_BLOCK - 1), last - b * _BLOCK)), lambda j: one(p, j)))

        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.floor(last / _BLOCK).cast("int")), block))).otherwise(F.array().cast(f"array<{_CHUNK}>"))

    return _let(normalize_whitespace(text), cut)


def segment(df: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per chunk: ``keep``, chunk_no, start_index, end_index, text, is_partial."""
    return df.select(*keep, F.inline(chunks(F.col(text), size, overlap)))


_FACTOR, _MASK64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` characters in a row."""
    out = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(_FACTOR) + codes[k : k + len(out)]
    return out


def _hashed(part: str) -> int:
    """The same of one part."""
    out = 0
    for c in part:
        out = (out * _FACTOR + ord(c)) & _MASK64
    return out


class _Target:
    """A text to look things up in; a long one by an index of its places and of what it holds."""

    def __init__(self, text: str) -> None:
        self.text, self.long = text, len(text) >= _LONG
        self.grams: dict[int, np.ndarray] = {}
        self.first: dict[str, int] = {}
        self.places: tuple[np.ndarray, np.ndarray] | None = None

    def _codes(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)

    def find(self, chunk: str, cursor: int) -> int:
        """The chunk's place behind the cursor, or else from the start; -1 if there is none."""
        if not self.long or len(chunk) < _GRAM:
            ahead = self.text.find(chunk, cursor)
            return ahead if ahead >= 0 else self.text.find(chunk)
        if self.places is None:
            rolled = _rolled(self._codes(), _GRAM)
            order = np.argsort(rolled, kind="stable").astype(np.int32)
            self.places = rolled[order], order
        hashes, order = self.places
        asked = np.uint64(_hashed(chunk[:_GRAM]))
        a, b = np.searchsorted(hashes, asked), np.searchsorted(hashes, asked, side="right")
        some = order[a:b]  # in the text's order
        turn = int(np.searchsorted(some, cursor))
        for part in (some[turn:], some[:turn]):
            for place in part:
                if self.text.startswith(chunk, int(place)):
                    return int(place)
        return -1

    def anywhere(self, word: str) -> int:
        if word not in self.first:
            self.first[word] = self.text.find(word) if not self.long or self._may_hold(word) else -1
        return self.first[word]

    def _may_hold(self, word: str) -> bool:
        """False only if the word's first characters stand nowhere in the text."""
        n = max(k for k in _GRAMS if k <= len(word))
        if n not in self.grams:
            self.grams[n] = np.unique(_rolled(self._codes(), n))
        known, asked = self.grams[n], np.uint64(_hashed(word[:n]))
        at = int(np.searchsorted(known, asked))
        return at < len(known) and known[at] == asked

    def near(self, chunk: str, cursor: int, threshold: float, window: int) -> int:
        """The place of the first word found, if enough of the chunk's words stand behind the cursor; else -1."""
        words = _WORD.findall(chunk)
        if not words:
            return -1
        part = self.text[cursor : cursor + window]
        if cursor + len(chunk) > len(self.text) or len(part) < len(chunk):
            places = [self.anywhere(w) for w in words]
        else:
            places = [p + cursor if p >= 0 else -1 for p in map(part.find, words)]
        found = [p for p in places if p >= 0]
        return found[0] if len(found) >= threshold * len(words) and found else -1


def _matched(size: int, step: int, threshold: float, window: int):
    def match(source: str, target: str) -> list[tuple[int, str]]:
        known, cursor, out = _Target(target), 0, []
        for at in _starts(len(source), size, step):
            chunk = source[at : at + size]
            place = known.find(chunk, cursor)
            if place >= 0:
                out.append((place, "exact"))
                cursor = place + len(chunk)
            else:
                place = known.near(chunk, cursor, threshold, window) if threshold <= 1 else -1
                out.append((place, "fuzzy" if place >= 0 else "missing"))
        return out

    return match


def _starts(n: int, size: int, step: int) -> range:
    return range(0, max(0, -(-(n - size) // step)) * step + 1, step) if n else range(0)


def _matches(size: int, step: int, threshold: float, window: int):
    """Batches of (doc_id, source, target), both normalised, with ``found``."""
    match = _matched(size, step, threshold, window)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                ends, rows = [0], []
                for source, target in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    n = len(source)
                    for k, (pos, kind) in enumerate(match(source, target)):
                        at = k * step
                        rows.append((k, at, min(at + size, n), source[at : at + size], n - at < size, pos, kind))
                    ends.append(len(rows))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [f.type for f in _FOUND.field("chunk").type]
                chunk = pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns[:5], kinds, strict=True)], fields=list(_FOUND.field("chunk").type))
                values = pa.StructArray.from_arrays([chunk, pa.array(columns[5], type=pa.int32()), pa.array(columns[6], type=pa.string())], fields=list(_FOUND))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)], ["doc_id", "target", "found"])

    return found


def _lis(values) -> int:
    """``tails[k]`` is the smallest last value of an increasing run of k + 1."""
    tails: list[int] = []
    for v in values:
        k = bisect.bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def lis_length(values: Column) -> Column:
    """Length of the longest strictly increasing subsequence of an array (0 for an empty one), by binary search."""
    ship(SparkSession.active())  # a function takes along what was handed over before it

    @F.pandas_udf("int")
    def length(arrays: pd.Series) -> pd.Series:
        return arrays.map(_lis, na_action="ignore")

    return length(values)


def match_table(pairs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, threshold: float = FUZZY, window: int = WINDOW) -> DataFrame:
    """doc_id, target (normalised) and ``found`` of pairs (doc_id, source, target): an array of (chunk, pos, kind).

    A chunk is looked for behind a cursor, then from the start; the cursor moves behind every exact
    hit, so it may move back. Else fuzzy: the share of the chunk's words that stand in a window
    behind the cursor, or in the whole target where that window is shorter than the chunk; the
    position is that of the first word found, and the cursor stays. Else pos is -1, kind missing.
    A ``threshold`` above 1 leaves the fuzzy search out.
    """
    step = _step(size, overlap)
    both = pairs.select("doc_id", normalize_whitespace(F.col("source")).alias("source"), normalize_whitespace(F.col("target")).alias("target"))
    kind = both.schema["doc_id"].dataType.simpleString()
    return map_arrow(both, _matches(size, step, threshold, window), f"doc_id {kind}, target string, found array<struct<chunk:{_CHUNK},pos:int,kind:string>>")


def scores(pairs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, significant: int = SIGNIFICANT) -> DataFrame:
    """One row per document: totals, completeness and order scores, verdict.

    Empty sources are complete and in order. Misses shorter than ``significant`` are noise: they
    lower the score, but are no failures. ``error`` marks documents with a null source or target.
    """
    n = F.size("found")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind))

    kinds = {k: of_kind(k) for k in ("exact", "fuzzy")}
    failed = F.filter("found", lambda f: (f["kind"] == "missing") & (F.length(strip(f["chunk"]["text"])) >= significant))
    hit = kinds["exact"] + kinds["fuzzy"]
    lis = lis_length(F.transform(F.filter("found", lambda f: f["kind"] != "missing"), lambda f: f["pos"]))
    out = match_table(pairs, size, overlap).select(
        "doc_id", n.alias("n_chunks"), kinds["exact"].alias("n_exact"), kinds["fuzzy"].alias("n_fuzzy"), F.size(failed).alias("n_failed"), hit.alias("n_found"), lis.alias("lis")
    )
    out = out.withColumn("completeness", F.when(F.col("n_chunks") == 0, 100.0).otherwise(F.col("n_found") * 100.0 / F.greatest("n_chunks", F.lit(1))))
    out = out.withColumn("order_score", F.when(F.col("n_found") == 0, 100.0).otherwise(F.col("lis") * 100.0 / F.greatest("n_found", F.lit(1))))
    good = (F.col("completeness") >= PASS_COMPLETENESS) & (F.col("order_score") >= PASS_ORDER)
    return out.withColumn("is_valid", F.col("n_failed") == 0).withColumn("status", F.when(good, "pass").otherwise("fail"))


def exact_scores(pairs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_chunks, n_found, lis, completeness and order_score by exact matches alone."""
    hits = F.transform(F.filter("found", lambda f: f["pos"] >= 0), lambda f: f["pos"]).alias("hits")
    both = match_table(pairs, size, overlap, 2.0).select("doc_id", F.size("found").alias("n_chunks"), hits)
    both = both.select("doc_id", "n_chunks", F.size("hits").alias("n_found"), lis_length(F.col("hits")).alias("lis"))
    complete = F.when(F.col("n_chunks") == 0, 100.0).otherwise(F.col("n_found") * 100.0 / F.greatest("n_chunks", F.lit(1)))
    order = F.when(F.col("n_found") == 0, 100.0).otherwise(F.col("lis") * 100.0 / F.greatest("n_found", F.lit(1)))
    return both.withColumns({"completeness": complete, "order_score": order})


def missing(pairs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, significant: int = SIGNIFICANT) -> DataFrame:
    """One row per failed chunk: doc_id, chunk_no, start_index, text, snippet."""
    # inline, not explode: fields of an exploded struct would be computed one by one, the matches each time.
    rows = match_table(pairs, size, overlap).select("doc_id", F.inline("found")).where("kind = 'missing'")
    rows = rows.select("doc_id", "chunk.chunk_no", "chunk.start_index", "chunk.text").where(F.length(strip(F.col("text"))) >= significant)
    return rows.withColumn("snippet", snippet(F.col("text")))


def reconcile(pairs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, threshold: float = RECONCILE) -> DataFrame:
    """Failed chunks once more, in comparison form: doc_id, chunk_no, coverage, resolution.

    Coverage is the share of the chunk's words that stand anywhere in the target; at the threshold
    the miss is ``approximate``, else ``unresolved``. Scores don't change.
    """
    both = match_table(pairs, size, overlap)
    failed = F.filter("found", lambda f: (f["kind"] == "missing") & (F.length(strip(f["chunk"]["text"])) >= SIGNIFICANT))
    both = both.select("doc_id", F.lower(comparison_form(F.col("target"))).alias("target"), failed.alias("failed"))

    def check(f: Column) -> Column:
        words = tokens(F.lower(comparison_form(f["chunk"]["text"])))
        n = F.size(words)
        found = F.size(F.filter(words, lambda t: F.position(t, F.col("target")) > 0))
        coverage = F.when(n > 0, F.round(found / F.greatest(n, F.lit(1)), 4)).otherwise(0.0)
        near = (n > 0) & (found >= threshold * n)
        return F.struct(f["chunk"]["chunk_no"].alias("chunk_no"), coverage.alias("coverage"), F.when(near, "approximate").otherwise("unresolved").alias("resolution"))

    return both.select("doc_id", F.inline(F.transform("failed", check)))


def report(pairs: DataFrame, examples: int = 3) -> DataFrame:
    """doc_id and a JSON report: status, summary, first missing snippets."""
    some = missing(pairs).groupBy("doc_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "snippet"))), lambda x: x["snippet"]), 1, examples).alias("missing"))
    rows = scores(pairs).join(some, "doc_id", "left")
    summary = F.struct("completeness", "order_score", "n_chunks", "n_exact", "n_fuzzy", "n_failed")
    return rows.select("doc_id", F.to_json(F.struct("status", summary.alias("summary"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))).alias("report"))
