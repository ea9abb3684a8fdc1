"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods.

A word is a run of letters (bytes a-z and non-ASCII, after lower-casing A-Z); its n-grams are
the byte trigrams of the word between two edges. Each language has a smoothed distribution over
``BUCKETS`` hashed trigrams, counted over all documents whose language is given and that are
not held out. A document is a mixture: each of its words comes from one language, and
expectation-maximisation estimates the proportions from the words' likelihoods. Candidate
language sets are the k likeliest languages; one more language is taken as long as it raises
the log-likelihood by more than its penalty of half the log of the number of words.

Counts are gathered per task and summed by Spark; the model has at most ``MAX_LANGUAGES`` x
``BUCKETS`` figures, a bound that the code checks. Scoring shuffles nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LETTER, LOWER, blocks, pieces, remainder, row_counts, runs
from quire.runtime import map_arrow

BUCKETS = 1 << 14
SMOOTHING = 0.5
FOLDS, HELD_OUT = 5, 0
#: More than this many languages to learn from is an error; none is left out.
MAX_LANGUAGES = 512
FULL_STEPS, SET_STEPS = 8, 6
#: A word tells at most this much (in nats) between languages, so that one odd word can't rule a language out.
CLIP = 12.0
#: Numbers of (trigram, language) figures that a worker handles at once.
FIGURES = 4 << 20
UNKNOWN = "und"


def _trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams, each word's first trigram, and each text's first word."""
    low = LOWER[raw]
    member = LETTER[low]
    starts, ends = runs(member, offsets)
    first_word = row_counts(starts, offsets)
    before, behind = np.zeros(len(low), dtype=np.uint32), np.zeros(len(low), dtype=np.uint32)
    before[1:], behind[:-1] = low[:-1], low[1:]
    before[starts] = 0
    behind[ends - 1] = 0
    here = np.flatnonzero(member)
    code = before[here] << np.uint32(16) | low[here].astype(np.uint32) << np.uint32(8) | behind[here]
    code = code * np.uint32(2654435761)
    buckets = ((code ^ code >> np.uint32(15)) % np.uint32(BUCKETS)).astype(np.int64)
    length = ends - starts
    return buckets, np.cumsum(length) - length, first_word


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, dtype=np.int64))
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, raw, offsets in pieces(batch.column(1)):
            buckets, first, first_word = _trigrams(raw, offsets)
            edges = np.append(first, len(buckets))[first_word]
            for k in range(b - a):
                if edges[k + 1] > edges[k]:
                    np.add.at(totals[langs[a + k]], buckets[edges[k] : edges[k + 1]], 1)
    for lang, total in totals.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), type=pa.string()), pa.array(some), pa.array(total[some])], ["lang", "bucket", "n"])


@dataclass
class Model:
    languages: list[str]
    #: log P(trigram | language), buckets x languages.
    table: np.ndarray

    def mixtures(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Proportions of the selected languages, texts x languages; zeros for texts without words."""
        n_texts, n_langs = len(offsets) - 1, len(self.languages)
        out = np.zeros((n_texts, n_langs))
        words, parts = np.zeros(n_texts, dtype=np.int64), []
        size = max(1 << 14, FIGURES // max(1, n_langs))
        for a, b in blocks(LETTER[LOWER[raw]], size):  # more than one only of a very long text
            buckets, first, first_word = _trigrams(raw[a:b], np.clip(offsets - a, 0, b - a))
            words += np.diff(first_word)
            if len(first) and n_langs:
                log = np.add.reduceat(self.table[buckets], first, axis=0)
                parts.append(np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -CLIP)))
        full = np.flatnonzero(words)
        if parts:
            out[full] = _selected(np.concatenate(parts), words[full])
        return out


def _steps(likely: np.ndarray, words: np.ndarray, mix: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some steps, and the log-likelihoods that they give. A language at 0 stays at 0."""
    head = np.cumsum(words) - words
    for step in range(steps + 1):
        per_word = likely * np.repeat(mix, words, axis=0)
        total = per_word.sum(axis=1)
        if step == steps:
            return mix, np.add.reduceat(np.log(total), head)
        mix = np.add.reduceat(per_word / total[:, None], head, axis=0) / words[:, None]
    raise AssertionError


def _selected(likely: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Proportions of the language set with the best penalised likelihood, for texts of ``words`` words each."""
    n_texts, n_langs = len(words), likely.shape[1]
    mix, _ = _steps(likely, words, np.full((n_texts, n_langs), 1 / n_langs, dtype=likely.dtype), FULL_STEPS)
    rank = np.argsort(np.argsort(-mix, axis=1, kind="stable"), axis=1, kind="stable")
    best = (rank == 0).astype(likely.dtype)
    _, score = _steps(likely, words, best, 0)
    active = np.arange(n_texts)
    likely_now, words_now = likely, words
    for k in range(2, n_langs + 1):
        start = np.where(rank[active] < k, np.maximum(mix[active], 1e-3), 0).astype(likely.dtype)
        found, value = _steps(likely_now, words_now, start / start.sum(axis=1, keepdims=True), SET_STEPS)
        value = value - (k - 1) * 0.5 * np.log(words_now + 1.0)
        better = value > score[active]
        best[active[better]], score[active[better]] = found[better], value[better]
        if not better.any():
            break
        likely_now = likely_now[np.repeat(better, words_now)]
        active, words_now = active[better], words_now[better]
    return best


def fit(documents: DataFrame, smoothing: float = SMOOTHING) -> Model:
    """Trigram distributions over all documents with text and lang that are not held out."""
    learn = documents.where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = map_arrow(learn, _counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))  # at most BUCKETS of each
    rows = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn from")
    rows.sort(key=lambda r: r.lang)
    table = np.full((BUCKETS, len(rows)), smoothing)
    for k, row in enumerate(rows):
        table[[c.bucket for c in row.counts], k] += [c.n for c in row.counts]
    return Model([r.lang for r in rows], np.log(table / table.sum(axis=0)).astype(np.float32))


def _predicted(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        limit = max(1 << 14, FIGURES // max(1, len(model.languages)))
        for batch in batches:
            langs, scores, sets = [], np.zeros(batch.num_rows), []
            for a, b, raw, offsets in pieces(batch.column(1), limit):
                mix = model.mixtures(raw, offsets)
                has = _has_letter(raw, offsets)
                for k in range(b - a):
                    known = has[k] and mix.shape[1] and mix[k].any()
                    at = int(mix[k].argmax()) if known else -1
                    langs.append(model.languages[at] if known else UNKNOWN)
                    scores[a + k] = min(1.0, float(mix[k, at])) if known else 0.0
                    sets.append([model.languages[j] for j in np.flatnonzero(mix[k] > 0)] if known else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, type=pa.string()), pa.array(scores), pa.array(sets, type=pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"]
            )

    return predict


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; where it has none of A-Z, its other characters decide."""
    ascii_letter = LETTER[LOWER[raw]] & (raw < 128)
    before = np.concatenate(([0], np.cumsum(ascii_letter)))
    has = before[offsets[1:]] > before[offsets[:-1]]
    for k in np.flatnonzero(~has):
        has[k] = any(map(str.isalpha, raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return has


def predicted(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, lang_pred, score (that language's proportion), languages (the selected set).

    ``und`` with score 0 where the text is null or has no letter, and where nothing was learned.
    Null and repeated doc_ids are rows like others; lang, source and doc_id are no inputs of a
    prediction. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))
    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), _predicted(shared), "doc_id long, lang_pred string, score double, languages array<string>")


def op2_language(documents: DataFrame) -> DataFrame:
    return predicted(documents).select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
