"""Toxicity: class-conditional Kneser-Ney models, compared per word.

Each class (toxic or ordinary, as ``labels.toxic`` marks training documents) has a model of
words with absolute discounting, its discount estimated from how many words it has once and twice.
The lost mass goes to one continuation distribution that both share: how many different words
stand before a word, in either class. Rare expressions thus fall back on the same counts in both
models. A word counts once in a document, and a text that occurs several times counts once,
so that bursts and copies don't look like evidence.

At order two, the query's, a class's model is of words after the word before: counts of pairs, all
their occurrences, less one, and for the rest the class's model of words. How much is left to that is
the same in both classes, as the one that knows the word before less leaves it; else a word before that the few
toxic texts hardly have would be evidence by itself. A word before is known by half its hash.

An ordinary text's words come from the ordinary model. A toxic text's come from the model that
explains the word better, the toxic one at the price of ``LIMIT`` nats, since most words of toxic
texts are ordinary too. The difference of the two log-likelihoods, divided by the number of
different words (at order two, pairs), is the text's figure; a logistic curve with a slope of 0 at least, fitted on
documents that the counts left out, makes a score of it.

Counts cover all labelled documents that are not held out. Tasks count word pairs, Spark sums
them by pair and then by word, where a word is its whole 64-bit hash: no two share figures, however
many there are. Log ratios are worked out in Spark. What is collected and broadcast are the words
whose ratio exceeds the limit, 12 bytes each, and the pairs where it isn't their word's; all others add nothing to any score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, MAP_BITS, WORD, checkpointed, mix64, pieces, remainder, row_counts, runs, span_hashes
from quire.runtime import map_arrow, remove, written

#: A word's pairs are dealt out in so many parts, so that a common word isn't one task's.
PARTS = 16
DISCOUNT = 0.75
#: What a word costs, in nats, that is put down to the toxic model.
LIMIT = 1.5
FOLDS, HELD_OUT = 4, 2
#: Of the training documents, those of this fold are left out of the counts that the curve is fitted on.
CURVE_FOLDS, CURVE_FOLD = 3, 1
#: Most documents that the curve is fitted on, by their hashed ids.
CURVE_SAMPLE = 6000
THRESHOLD = 0.3
#: The order of the query's models.
ORDER = 2
#: Word pairs that a task gathers before it passes their sums on.
HELD_PAIRS = 1 << 20
#: More than the texts among those take.
TEXT_BITS = 24


class _Words:
    """Words of some texts as hashes, the word before each, and where a word first stands in its text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        low = LOWER[raw]
        starts, ends = runs(WORD[low], offsets)
        self.words = span_hashes(low, starts, ends).view(np.int64)
        self.per_text = np.diff(row_counts(starts, offsets))
        self.text = np.repeat(np.arange(len(self.per_text)), self.per_text)
        self.first = self.firsts(self.words)

    def firsts(self, values: np.ndarray) -> np.ndarray:
        """Where each different value, one for each word, first stands in its text."""
        order = np.lexsort((values, self.text))
        text, values = self.text[order], values[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
        out = np.zeros(len(order), dtype=bool)
        out[order[new]] = True
        return out

    def before(self) -> np.ndarray:
        """32 bits of the hash of the word before each; a text's first word stands behind 0.

        Half a hash halves what is shuffled: of a million different words before one word, some hundred fall together.
        """
        before = np.zeros(len(self.words), dtype=np.int64)
        if len(before):
            before[1:] = np.where(self.text[1:] == self.text[:-1], (self.words[:-1].view(np.uint64) >> np.uint64(32)).view(np.int64), 0)
        return before


def _summed(held: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(held, axis=1)
    rows = rows[:, np.lexsort(rows[1::-1])]  # a word's rows stand together, so that the shuffle packs them well
    heads = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[:2, heads], np.add.reduceat(rows[2], heads))], ["word", "of", "n"])


def _word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, of, n), packed to shuffle less.

    The lower 32 bits of ``of`` are the word before, the others 2 * toxic + whether the document is
    for the curve. The lower ``TEXT_BITS`` bits of n count the texts whose first such word it is, the
    others all occurrences of the pair.
    """
    held, size = [], 0
    for batch in batches:
        kinds = batch.column(0).to_numpy().astype(np.int64)
        for a, b, raw, offsets in pieces(batch.column(1)):
            words = _Words(raw, offsets)
            held.append(np.stack([words.words, kinds[a:b][words.text] << 32 | words.before(), words.first.astype(np.int64) + (1 << TEXT_BITS)]))
            size += len(words.words)
            if size >= HELD_PAIRS:
                yield _summed(held)
                held, size = [], 0
    if size:
        yield _summed(held)


def _places(learn: DataFrame, marks: DataFrame, size: int) -> np.ndarray:
    """A code for each of ``size`` places that ids hash to, as three maps of bits.

    0: no marked id; 1: a marked id beside others, or marked twice; 2 and more: one id, and its kind.
    """
    kinds = marks.select("doc_id", (F.col("toxic") * 2 + F.col("curve")).alias("kind"))
    rows = learn.where("doc_id IS NOT NULL").select("doc_id", F.lit(None).cast("int").alias("kind")).union(kinds)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("b")
    places = rows.groupBy(place).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("kind").alias("n"), F.max("kind").alias("kind")).where("n > 0")
    code = F.when((F.col("n") == 1) & (F.col("lo") == F.col("hi")), F.col("kind") + 2).otherwise(F.lit(1))
    one = F.expr("shiftleft(1L, cast(b & 31 as int))")
    planes = [F.bit_or(F.when(F.col("code").bitwiseAND(F.lit(1 << k)) != 0, F.col("one")).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(3)]
    got = places.select(F.shiftright("b", 5).alias("w"), one.alias("one"), code.cast("int").alias("code")).groupBy("w").agg(*planes).toArrow()
    bits = np.zeros((3, (size + 31) >> 5), dtype=np.uint32)
    for k in range(3):
        bits[k, got.column("w").to_numpy()] = got.column(f"p{k}").to_numpy().astype(np.uint32)
    return bits


def _coded(shared, shuffled: bool):
    """Of rows (doc_id, text, place): (doc_id, text) of those whose id shares its place, or (kind, text) of the others that are marked."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            code = np.zeros(len(place), dtype=np.int64)
            for k in range(3):
                code |= (shared.value[k, place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(np.int64) << k
            kept = pa.array(code == 1 if shuffled else code > 1)
            first, name = (batch.column(0), "doc_id") if shuffled else (pa.array(code - 2), "kind")
            yield pa.RecordBatch.from_arrays([first.filter(kept), batch.column(1).filter(kept)], [name, "text"])

    return coded if shuffled else (lambda batches: _word_pairs(coded(batches)))  # in one Python worker


def _counted(learn: DataFrame, marks: DataFrame, size: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """Word pairs of the texts of ``learn`` (doc_id, text) that ``marks`` (doc_id, toxic, curve) has, and those texts that are shuffled for it.

    Kinds come from maps of a fixed size. Where several ids fall on one place, a join by the id decides.
    """
    shared = learn.sparkSession.sparkContext.broadcast(_places(learn, marks, size))
    rows = learn.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("place"))
    shuffled = map_arrow(rows, _coded(shared, True), rows.select("doc_id", "text").schema)
    texts = shuffled.join(marks, "doc_id").select((F.col("toxic") * 2 + F.col("curve")).alias("kind"), "text")
    schema = "word long, of long, n long"
    return map_arrow(rows, _coded(shared, False), schema).union(map_arrow(texts, _word_pairs, schema)), shuffled


@dataclass
class Excess:
    """By how much the log ratios of words exceed the limit, by hash, sorted; words that don't aren't there."""

    words: np.ndarray
    values: np.ndarray
    #: Of order two: pairs whose excess isn't their word's, by ``_pair_hashes``.
    pairs: Excess | None = None

    def of(self, words: np.ndarray, otherwise: np.ndarray | float = 0.0) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words)) + otherwise
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.values[at].astype(np.float64), otherwise)


def _pair_hashes(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix64(words.view(np.uint64) ^ mix64(before.astype(np.int64).view(np.uint64) + np.uint64(1))).view(np.int64)


def _excess(keys: np.ndarray, values: np.ndarray, pairs: Excess | None = None) -> Excess:
    order = np.argsort(keys)
    return Excess(keys[order], values[order], pairs)


def discount(once: int, twice: int) -> float:
    """The usual estimate of a class's discount; 0.75 where there is nothing to estimate it from."""
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def _learned(counted: DataFrame, order: int) -> tuple[Excess, Excess]:
    """Words with evidence, without the curve's documents and of all, from counts by word, word before and kind of document."""
    part, before, kind = F.pmod("of", F.lit(PARTS)), F.col("of").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("of", 32)
    n, m = F.col("n").bitwiseAND(F.lit((1 << TEXT_BITS) - 1)), F.shiftright("n", TEXT_BITS)
    by_kind = [F.sum(F.when(kind == k, x).otherwise(0)).alias(f"{name}{k}") for name, x in (("n", n), ("m", m)) for k in range(4)]
    by_pair = counted.repartition("word", part).groupBy("word", part.alias("part"), before.alias("before")).agg(*by_kind, F.max(F.when(kind.isin(0, 2), 1).otherwise(0)).alias("d"))
    names = ("n0", "n1", "n2", "n3", "d", "every", "m0", "m1", "m2", "m3")
    own = F.struct(F.lit(None).cast("long").alias("before"), *[(F.lit(1) if x == "every" else F.col(x)).cast("long").alias(x) for x in names])
    # A text's first word has no word before it.
    repeated = (F.col("before") != 0) & ((F.col("m0") + F.col("m1") > 1) | (F.col("m2") + F.col("m3") > 1))
    pair = F.when(repeated, F.struct("before", *[(F.col(x) if x[0] == "m" else F.lit(0)).cast("long").alias(x) for x in names]))
    rows = F.explode(F.array_compact(F.array(own, pair) if order > 1 else F.array(own)))
    sums, path = written(by_pair.select("word", rows.alias("r")).select("word", "r.*").groupBy("word", "before").agg(*[F.sum(x).alias(x) for x in names]))
    by_word = sums.where("before IS NULL")
    out = []
    for ordinary, toxic, preceders in (("n0", "n2", "d"), ("n0 + n1", "n2 + n3", "every")):
        preceders = F.col(preceders)
        counts = {"o": F.expr(ordinary), "t": F.expr(toxic)}
        figures = [F.coalesce(F.sum(preceders), F.lit(0)).alias("p"), F.count(F.when(preceders > 0, 1)).alias("kinds")]
        for name, c in counts.items():
            figures += [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{name}"), F.count(F.when(c > 0, 1)).alias(f"kinds_{name}"), F.count(F.when(c == 1, 1)).alias(f"once_{name}"), F.count(F.when(c == 2, 1)).alias(f"twice_{name}")]
        got = by_word.agg(*figures).collect()[0]
        # One more word stands for all that were never seen.
        shared = (preceders + 0.5) / (got.p + 0.5 * (got.kinds + 1))
        likely = {}
        for name, c in counts.items():
            total, d = max(1.0, float(got[f"total_{name}"])), discount(got[f"once_{name}"], got[f"twice_{name}"])
            lost = max(got[f"kinds_{name}"], 1) * d / total  # a discount is below 1, and counts are not
            likely[name] = F.greatest(c - d, F.lit(0.0)) / total + lost * shared
        x = (F.log(likely["t"]) - F.log(likely["o"]) - LIMIT).cast("float")
        pairs = _pairs(by_word, sums.where("before IS NOT NULL"), likely, ordinary.replace("n", "m"), toxic.replace("n", "m")) if order > 1 else None
        rows = by_word.select("word", x.alias("x")).where("x > 0").toArrow()
        out.append(_excess(rows.column("word").to_numpy(), rows.column("x").to_numpy(), pairs))
    remove(counted.sparkSession, path)
    return out[0], out[1]


def _pairs(by_word: DataFrame, repeated: DataFrame, likely: dict[str, Column], ordinary: str, toxic: str) -> Excess:
    """Pairs of words whose excess isn't their second word's own.

    Of a pair's occurrences one is discounted, so pairs that occur once leave all their mass to the
    word alone. Both classes leave the share of the one that knows the word before less, what is
    kept goes by each class's own counts, and a word before that one class hasn't in any repeated
    pair leaves all. A pair that neither class repeats thus has its word's ratio.
    """
    more = {c: F.greatest(F.expr(n) - 1, F.lit(0)) for c, n in (("o", ordinary), ("t", toxic))}
    kept = repeated.groupBy("before").agg(*[F.sum(x).alias(f"kept_{c}") for c, x in more.items()]).where("kept_o > 0 AND kept_t > 0")
    seen = by_word.groupBy(F.shiftrightunsigned("word", 32).alias("before")).agg(F.sum(F.expr(ordinary)).alias("seen_o"), F.sum(F.expr(toxic)).alias("seen_t"))
    left = F.greatest(*[1 - F.col(f"kept_{c}") / F.col(f"seen_{c}") for c in "ot"])
    contexts = kept.join(seen, "before").select("before", "kept_o", "kept_t", left.alias("left"))
    rows = repeated.select("word", "before", *[x.alias(f"more_{c}") for c, x in more.items()]).where("more_o > 0 OR more_t > 0").join(contexts, "before")
    rows = rows.join(by_word.select("word", *[x.alias(f"word_{c}") for c, x in likely.items()]), "word")
    t, o = (F.col("left") * F.col(f"word_{c}") + (1 - F.col("left")) * F.col(f"more_{c}") / F.col(f"kept_{c}") for c in "to")
    excess = lambda t, o: F.greatest(F.log(t) - F.log(o) - LIMIT, F.lit(0.0)).cast("float")
    rows = rows.select("word", "before", excess(t, o).alias("x"), excess(F.col("word_t"), F.col("word_o")).alias("alone")).where("x != alone").select("word", "before", "x").toArrow()
    return _excess(_pair_hashes(rows.column("word").to_numpy(), rows.column("before").to_numpy()), rows.column("x").to_numpy())


@dataclass
class Model:
    excess: Excess
    #: Intercept and slope.
    curve: tuple[float, float]

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * _figures(self.excess, raw, offsets), -30, 30)))


def _figures(excess: Excess, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: the difference of its log-likelihoods, divided by its number of different words, or pairs of words."""
    words = _Words(raw, offsets)
    n = len(offsets) - 1
    first, values = words.first, excess.of(words.words)
    if excess.pairs:
        keys = _pair_hashes(words.words, words.before())
        first, values = words.firsts(keys), excess.pairs.of(keys, values)
    text = words.text[first]
    return np.bincount(text, weights=values[first], minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a little ridge, on a figure scaled to unit spread; a slope below 0 becomes 0."""
    scale = 1 / max(x.std(), 1e-9)
    both = np.stack([np.ones(len(x)), x * scale], axis=1)
    for columns in (2, 1):
        a, w = both[:, :columns], np.zeros(columns)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(columns), a.T @ (y - p) - 0.1 * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if columns == 1 or w[1] >= 0:
            return float(w[0]), float(w[1] * scale) if columns == 2 else 0.0
    raise AssertionError


def _measured(shared):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_figures(shared.value, raw, offsets))], ["key", "x"])

    return measure


def fit(documents: DataFrame, labels: DataFrame, sample: int = CURVE_SAMPLE, order: int = 1) -> Model:
    """Counts over all labelled documents that are not held out; a curve on ``sample`` of them at most.

    Labels that are null or of no document are ignored; of several labels of a document the
    largest counts, and of several texts of a doc_id each counts, but the curve takes the one whose
    hash is the smallest. Documents with the same text count once, with the label that most of them
    have, or that of the smallest id if there are as many of each. Without any label every score is 0.5.
    """
    marks = labels.where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = documents.where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("text").isNotNull()).select("doc_id", "text")
    marks = learn.select("doc_id", F.xxhash64("text").alias("h")).join(marks, "doc_id")  # ids and hashes; no text is shuffled here
    votes = F.sum(F.when(F.col("toxic") != 0, 1).otherwise(-1))
    marks = marks.groupBy("h").agg(F.when(votes > 0, 1).when(votes < 0, 0).otherwise(F.min_by("toxic", "doc_id")).alias("toxic"), F.min("doc_id").alias("doc_id"))
    curve = F.pmod(F.xxhash64("doc_id"), F.lit(CURVE_FOLDS)) == CURVE_FOLD
    marks = checkpointed(marks.select("doc_id", F.when(F.col("toxic") != 0, 1).otherwise(0).alias("toxic"), curve.cast("int").alias("curve")).distinct())
    some_words, all_words = _learned(_counted(learn, marks)[0], order)
    without = documents.sparkSession.sparkContext.broadcast(some_words)
    some = marks.where("curve = 1").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample).select("doc_id", "toxic")
    texts = learn.join(F.broadcast(some), "doc_id")  # ``sample`` rows at most
    key = F.struct("doc_id", "toxic", F.xxhash64("text").alias("h")).alias("key")
    rows = map_arrow(texts.select(key, "text"), _measured(without), "key struct<doc_id:long,toxic:int,h:long>, x double")
    rows = rows.groupBy("key.doc_id").agg(F.min(F.struct("key.h", "x", "key.toxic")).alias("r")).select("r.x", "r.toxic").toArrow()
    without.unpersist()
    found = sorted(zip(rows.column("x").to_pylist(), rows.column("toxic").to_pylist(), strict=True))
    x, y = np.array([x for x, _ in found]), np.array([y for _, y in found], dtype=float)
    return Model(all_words, _logistic(x, y) if found else (0.0, 0.0))


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, raw, offsets in pieces(batch.column(1)):
                scores[a:b] = model.scores(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return score


def scored(documents: DataFrame, labels: DataFrame, order: int = 1) -> DataFrame:
    """Per document: doc_id and score, from 0 to 1, by models of words (order 1) or of pairs of words that fall back on them (2).

    A null or empty text has no words, the figure 0, and the curve's score for that. Null and
    repeated doc_ids are rows like others; labels, lang, source and doc_id are no inputs of a
    score. Texts of any length are scored whole. An empty table gives an empty result. Other
    columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, order=order))
    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), _scored(shared), "doc_id long, score double")


def op5_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(documents, labels, ORDER)
    return found.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
