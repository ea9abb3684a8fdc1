"""Benchmark decontamination: a prefix-filtered containment join of item windows and documents.

A window is ``WINDOW`` consecutive words of an item, or all of a shorter item. A document that
contains it contains every one of its words, so one necessary prefix token is enough to find
all candidates: its rarest word, by how often the item words occur in all documents. Documents
look their words up among the prefix tokens; a match at position p proposes the start p - offset,
which length and position bounds keep within the document; a rolling hash of the words there and
then the words themselves verify the window.

The index of item windows goes to the workers, not the documents to the items: no text is
shuffled, and hot words or passages stay where they are. Items are indexed in blocks of about
``BLOCK_BYTES`` of text; a larger benchmark makes more blocks, which a worker reads one after
another for each batch, so its memory doesn't grow with the benchmark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, WORD, pieces, row_counts, runs, span_hashes
from quire.runtime import checkpointed, map_arrow

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: About so many pairs of a word and a window are looked at in one go.
EXPANDED = 1 << 20


class _Words:
    """The words of a piece of texts: places, hashes, and each text's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.low = LOWER[raw]
        self.starts, self.ends = runs(WORD[self.low], offsets)
        self.hashes = span_hashes(self.low, self.starts, self.ends)
        self.first = row_counts(self.starts, offsets)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, joined by blanks."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))


def _words(texts: list[str]) -> _Words:
    column = pa.array(texts, type=pa.large_string())
    for _, _, raw, offsets in pieces(column, 1 << 62):
        return _Words(raw, offsets)
    return _Words(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))


def vocabulary(texts: list[str]) -> np.ndarray:
    return np.unique(_words(texts).hashes)


class Index:
    """Windows of some items by their rarest word."""

    def __init__(self, items: list[tuple[str, str]], frequency: dict[int, int], window: int) -> None:
        words = _words([t for _, t in items])
        seen: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.items: list[set[str]] = []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        lengths, hashes = [], []
        for row, (item, _) in enumerate(items):
            a, b = int(words.first[row]), int(words.first[row + 1])
            size = min(window, b - a)
            for start in range(a, b - size + 1) if size else ():
                text = words.text(start, start + size)
                if text in seen:
                    self.items[seen[text]].add(item)
                    continue
                seen[text] = at = len(self.texts)
                self.texts.append(text)
                self.items.append({item})
                own = words.hashes[start : start + size]
                rarest = min(range(size), key=lambda k: (frequency.get(int(own[k]), 0), int(own[k]), k))
                postings[int(own[rarest])].append((rarest, at))
                lengths.append(size)
                hashes.append(span_hashes(own, np.array([0]), np.array([size]))[0])
        self.lengths, self.hashes = np.array(lengths, dtype=np.int64), np.array(hashes, dtype=np.uint64)
        self.tokens = np.array(sorted(postings), dtype=np.uint64)
        flat = [p for t in self.tokens.tolist() for p in postings[t]]
        self.n_postings = np.array([len(postings[t]) for t in self.tokens.tolist()], dtype=np.int64)
        self.first_posting = np.cumsum(self.n_postings) - self.n_postings
        self.offsets = np.array([o for o, _ in flat], dtype=np.int64)
        self.windows = np.array([w for _, w in flat], dtype=np.int64)

    def occurrences(self, words: _Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence, verified word by word."""
        if not len(self.tokens) or not len(words.hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, words.hashes), len(self.tokens) - 1)
        places = np.flatnonzero(self.tokens[at] == words.hashes)
        at = at[places]
        total = np.cumsum(self.n_postings[at])
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, EXPANDED)), len(at)))
        parts = [self._verified(words, places[a:b], at[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if b > a]
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _verified(self, words: _Words, places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences that some matches of prefix tokens, at ``places``, lead to."""
        n = self.n_postings[at]
        place = np.repeat(places, n)
        posting = np.repeat(self.first_posting[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window, start = self.windows[posting], place - self.offsets[posting]
        end = start + self.lengths[window]
        text = np.searchsorted(words.first, place, side="right") - 1
        inside = (start >= words.first[text]) & (end <= words.first[text + 1])
        window, start, end = window[inside], start[inside], end[inside]
        same = span_hashes(words.hashes, start, end) == self.hashes[window] if len(start) else np.zeros(0, dtype=bool)
        window, start = window[same], start[same]
        exact = np.fromiter((words.text(s, s + self.lengths[w]) == self.texts[w] for s, w in zip(start.tolist(), window.tolist(), strict=True)), dtype=bool, count=len(start))
        return start[exact], window[exact]


def _counted(vocabularies: list[Broadcast]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray | None] = [None] * len(vocabularies)
        for batch in batches:
            for _, _, raw, offsets in pieces(batch.column(0)):
                hashes = _Words(raw, offsets).hashes
                for block, shared in enumerate(vocabularies):
                    known = shared.value
                    if totals[block] is None:
                        totals[block] = np.zeros(len(known), dtype=np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        totals[block] += np.bincount(at[known[at] == hashes], minlength=len(known))
                    if len(vocabularies) > 1:
                        shared.__dict__.pop("_value", None)  # one vocabulary in memory at a time, and the counts of all
        for block, (total, shared) in enumerate(zip(totals, vocabularies, strict=True)):
            if total is None:
                continue
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block, dtype=np.int32)), pa.array(shared.value[some].view(np.int64)), pa.array(total[some])], ["block", "word", "n"])

    return count


def _indexes(documents: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list[Broadcast]:
    """An index for each block of items; the driver holds one block at a time."""
    sc = documents.sparkSession.sparkContext
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    blocks = max(1, -(-total // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))

    def block(k: int) -> list[tuple[str, str]]:
        return sorted((r.item, r.text) for r in items.where(F.col("block") == k).select("item", "text").distinct().collect())

    vocabularies = [sc.broadcast(vocabulary([t for _, t in block(k)])) for k in range(blocks)]
    counts = map_arrow(documents.select("text"), _counted(vocabularies), "block int, word long, n long").groupBy("block", "word").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)  # documents are read once for it, however many blocks there are
    out = []
    for k in range(blocks):  # at most a block's words come back
        found = counts.where(F.col("block") == k) if blocks > 1 else counts
        frequency = {r.word & ((1 << 64) - 1): r.n for r in found.collect()}
        out.append(sc.broadcast(Index(block(k), frequency, window)))
    return out


def _hits(indexes: list[Broadcast]):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            n_hit = np.zeros(batch.num_rows, dtype=np.int64)
            items: dict[int, set[str]] = defaultdict(set)
            loaded = [x.value for x in indexes] if len(indexes) == 1 else None
            for a, b, raw, offsets in pieces(batch.column(1)):
                words = _Words(raw, offsets)
                n_words[a:b] = np.diff(words.first)
                cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                for shared in indexes:
                    index = loaded[0] if loaded else shared.value
                    start, window = index.occurrences(words)
                    if len(start):
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + index.lengths[window], -1)
                        rows = np.searchsorted(words.first, start, side="right") - 1
                        for row, w in set(zip(rows.tolist(), window.tolist(), strict=True)):
                            items[a + row] |= index.items[w]
                    if not loaded:
                        shared.__dict__.pop("_value", None)  # read again from the executor's file when its turn comes
                covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
                n_hit[a:b] = covered[words.first[1:]] - covered[words.first[:-1]]
            names = [",".join(sorted(items[k])) if k in items else "" for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words),
                    pa.array(n_hit),
                    pa.array([len(items[k]) if k in items else 0 for k in range(batch.num_rows)], type=pa.int64()),
                    pa.array(names, type=pa.string()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items"],
            )

    return hits


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items and items (ids sorted as strings, comma-joined).

    A-Z are lower-cased; words are runs of digits, a-z and non-ASCII characters. Null and empty
    texts have no words and no hits. Items with a null id or text take no part; an item id that
    occurs twice counts once, with the windows of all its texts. Null and repeated doc_ids are
    rows like others. Either table may be empty. Other columns are ignored.
    """
    indexes = _indexes(documents, benchmark, window, block_bytes)
    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), _hits(indexes), "doc_id long, n_words long, n_hit long, n_items long, items string")


def op4_decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(documents, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean(indexes: list[Broadcast], at: int):
    hits = _hits(indexes)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nobody = pa.nulls(batch.num_rows, pa.int64())
            found = next(hits(iter([pa.RecordBatch.from_arrays([nobody, batch.column(at)], ["doc_id", "text"])])))
            yield batch.filter(pa.array(found.column("n_hit").to_numpy() == 0))

    return keep


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents``, all their columns, that hold no window of any item; nothing is shuffled."""
    indexes = _indexes(documents, benchmark, window, block_bytes)
    return map_arrow(documents, _clean(indexes, documents.columns.index("text")), documents.schema)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS s FROM d, ks)),
m AS (SELECT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
