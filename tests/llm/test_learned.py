"""Classifiers: accuracy on held-out rows, and rows that have nothing to score."""

import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language, quality, toxicity
from tests.llm.helpers import DATA, duck, have_data

DOCS = "doc_id long, text string, lang string, source string, score string"
needs_data = pytest.mark.skipif(not have_data(), reason="no driver tables")


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def auc(labels, scores):
    pairs = [(s, t) for s, a in zip(scores, labels, strict=True) if a for t, b in zip(scores, labels, strict=True) if not b]
    return sum((s > t) + 0.5 * (s == t) for s, t in pairs) / len(pairs)


@needs_data
def test_quality_on_held_out_documents(spark):
    got = quality.op1_quality(read(spark, "documents"), read(spark, "labels")).toPandas()
    ids = read(spark, "documents").toPandas().doc_id
    assert sorted(got.doc_id) == sorted(ids) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(duck().execute("select doc_id, quality from labels").df(), on="doc_id")
    held = both[both.held_out]
    assert auc(held.quality, held.score) > 0.85


@needs_data
def test_language_on_held_out_documents(spark):
    got = language.op2_language(read(spark, "documents")).toPandas()
    both = got.merge(duck().execute("select doc_id, lang from documents").df(), on="doc_id")
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()


def test_mixture_proportions_and_language_set(spark):
    """Two languages with words of their own: proportions come back, and a pure text has one language."""
    rng = random.Random(1)
    first, second, third = (["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(200)] for a in ("abcde", "uvwxy", "éèàô"))

    def text(counts):
        return " ".join(rng.choice(v) for v, n in zip((first, second, third), counts, strict=True) for _ in range(n))

    learn = [(k, text(c), lang, "s", "x") for k, (c, lang) in enumerate([((80, 0, 0), "aa"), ((0, 80, 0), "bb"), ((0, 0, 80), "cc")] * 20)]
    ask = [(1000, text((70, 30, 0)), None, "s", "x"), (1001, text((0, 60, 0)), None, "s", "x"), (1002, "12 34 !?", None, "s", "x"), (1003, None, None, "s", "x"), (None, "", "zz", "s", "x")]
    got = {r.doc_id: r for r in language.predicted(spark.createDataFrame(learn + ask, DOCS)).where("doc_id >= 1000 or doc_id is null").collect()}
    assert got[1000].lang_pred == "aa" and abs(got[1000].score - 0.7) < 0.03 and sorted(got[1000].languages) == ["aa", "bb"]
    assert got[1001].languages == ["bb"] and got[1001].score == pytest.approx(1, abs=1e-3)
    assert [(got[k].lang_pred, got[k].score) for k in (1002, 1003, None)] == [("und", 0.0)] * 3


def test_languages_of_nothing_and_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "aa ab ba", "x", "s", "c"), (1, "aa ab ba", "x", "s", "c"), (2, "zz zy yz", "y", "s", "c"), (None, "zy zz", "y", "s", "c")], DOCS)
    assert language.op2_language(docs.limit(0)).count() == 0
    got = language.predicted(docs).collect()
    assert [r.lang_pred for r in got if r.doc_id == 1] == ["x", "x"] and len(got) == 4
    assert {r.lang_pred for r in language.predicted(docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "score")).collect()} == {"und"}


def test_language_sets_against_a_plain_loop():
    """The batched steps against expectation-maximisation one text at a time."""
    rng = np.random.default_rng(2)
    words = np.array([5, 1, 40, 12])
    likely = rng.random((words.sum(), 3)).astype(np.float64) ** 4 + 1e-4
    got = language._selected(likely, words)

    def steps(x, mix, n):
        for _ in range(n):
            r = x * mix
            mix = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        return mix, np.log((x * mix).sum(axis=1)).sum()

    at = 0
    for k, n in enumerate(words):
        x = likely[at : at + n]
        at += n
        mix, _ = steps(x, np.full(3, 1 / 3), language.FULL_STEPS)
        rank = np.argsort(-mix, kind="stable")
        best, score = np.eye(3)[rank[0]], steps(x, np.eye(3)[rank[0]], 0)[1]
        for size in (2, 3):
            start = np.where(np.isin(np.arange(3), rank[:size]), np.maximum(mix, 1e-3), 0)
            found, value = steps(x, start / start.sum(), language.SET_STEPS)
            value -= (size - 1) * 0.5 * math.log(n + 1)
            if value <= score:
                break
            best, score = found, value
        assert got[k] == pytest.approx(best, abs=1e-6)


def marked(spark, n=600, seed=3):
    """Documents of which a third hold words of a small lexicon, and their labels."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for k in range(n):
        bad = k % 3 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for _ in range(max(1, len(text) // 25) if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(["nasty", "vile", "horrid"])
        docs.append((k, " ".join(text), None, "s", "x"))
        labels.append((k, int(not bad), int(bad)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = marked(spark)
    extra = spark.createDataFrame([(None, None, None, "s", "x"), (9001, "", None, "s", "x"), (9002, "calm words only", None, "s", "x")], DOCS)
    got = toxicity.op5_toxicity(docs.union(extra), labels).toPandas()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (both.held_out == [zlib.crc32(str(int(d)).encode()) % 4 == 2 for d in both.doc_id]).all()
    assert auc(held.toxic, held.score) > 0.95 and ((held.score >= 0.3) == held.toxic).mean() > 0.9
    assert got.score.between(0, 1).all() and len(got) == 603


def brute_figures(learn, texts):
    """The figure of each text from its words, by plain loops; ``learn`` has (toxic, text), each text once."""
    words_of = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts, pairs = ({}, {}), set()
    for toxic, text in learn:
        words = words_of(text)
        for w in set(words):
            counts[toxic][w] = counts[toxic].get(w, 0) + 1
        pairs |= set(zip([None, *words], words, strict=False))
    vocabulary = {w for _, w in pairs}
    preceders = {v: sum(w == v for _, w in pairs) for v in vocabulary}

    def likelihood(w, c):
        total, once, twice = sum(c.values()), sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = once / (once + 2 * twice) if once and twice else 0.75
        shared = (preceders.get(w, 0) + 0.5) / (len(pairs) + 0.5 * (len(vocabulary) + 1))
        return max(c.get(w, 0) - d, 0) / total + d * len(c) / total * shared

    out = []
    for text in texts:
        words = set(words_of(text))
        out.append(sum(max(0.0, math.log(likelihood(w, counts[1]) / likelihood(w, counts[0])) - toxicity.LIMIT) for w in words) / max(1, len(words)))
    return out


def test_toxicity_scores_against_brute_force(spark):
    docs, labels = marked(spark, 200)
    rows, toxic = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    learn = [(toxic[k], t) for k, t in rows.items() if zlib.crc32(str(k).encode()) % 4 != 2]
    ask = [*rows.values(), "", "Nasty, VILE nasty things", "nothing known here at all"]
    figures = np.array(brute_figures(learn, ask))
    model = toxicity.fit(docs, labels)
    assert (figures > 0).sum() > 50 and model.curve[1] > 0
    more = spark.createDataFrame([(10_000 + k, t, None, "s", "x") for k, t in enumerate(ask[200:])], DOCS)
    got = {r.doc_id: r.score for r in toxicity.scored(docs.union(more), labels).collect()}
    for k, x in zip([*rows, 10_000, 10_001, 10_002], figures, strict=True):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * x))), abs=1e-5)


def brute_pair_figures(learn, texts):
    """The figure of each text at order two, by plain loops; ``learn`` has (toxic, text), each text once."""
    words_of = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts, tokens, pairs = ({}, {}), ({}, {}), ({}, {})
    for toxic, text in learn:
        words = words_of(text)
        for w in set(words):
            counts[toxic][w] = counts[toxic].get(w, 0) + 1
        for v, w in zip([None, *words], words, strict=False):
            tokens[toxic][w] = tokens[toxic].get(w, 0) + 1
            pairs[toxic][v, w] = pairs[toxic].get((v, w), 0) + 1
    different = {*pairs[0], *pairs[1]}
    preceders = {}
    for _, w in different:
        preceders[w] = preceders.get(w, 0) + 1
    kept = [{}, {}]
    for c in (0, 1):
        for (v, _), n in pairs[c].items():
            if v is not None and n > 1:
                kept[c][v] = kept[c].get(v, 0) + n - 1
    sums = [(sum(c.values()), sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for c in counts]

    def alone(w, c):
        total, once, twice = sums[c]
        d = once / (once + 2 * twice) if once and twice else 0.75
        shared = (preceders.get(w, 0) + 0.5) / (len(different) + 0.5 * (len(preceders) + 1))
        return max(counts[c].get(w, 0) - d, 0) / total + d * len(counts[c]) / total * shared

    def likelihood(v, w, c):
        if v not in kept[0] or v not in kept[1]:
            return alone(w, c)
        left = max(1 - kept[k][v] / tokens[k][v] for k in (0, 1))
        return left * alone(w, c) + (1 - left) * max(pairs[c].get((v, w), 0) - 1, 0) / kept[c][v]

    out = []
    for text in texts:
        words = words_of(text)
        there = set(zip([None, *words], words, strict=False))
        out.append(sum(max(0.0, math.log(likelihood(v, w, 1) / likelihood(v, w, 0)) - toxicity.LIMIT) for v, w in there) / max(1, len(there)))
    return out


def test_toxicity_of_word_pairs_against_brute_force(spark):
    """The query's models are of words after the word before, not of words alone."""
    docs, labels = marked(spark, 200)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    docs = docs.withColumn("text", F.expr("concat_ws(' ', text, 'so very odd', if(doc_id % 3 = 0, 'you stale bread you old bread', 'you fresh bread you old man'))"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    learn = [(toxic[k], t) for k, t in rows.items() if zlib.crc32(str(k).encode()) % 4 != 2]
    ask = ["", "you stale bread", "you old bread", "old bread", "bread", "you fresh bread", "Nasty, VILE nasty things", "nothing known here at all"]
    more = spark.createDataFrame([(10_000 + k, t, None, "s", "x") for k, t in enumerate(ask)], DOCS)
    texts = [*rows.values(), *ask]
    figures, words = brute_pair_figures(learn, texts), brute_figures(learn, texts)
    assert sum(abs(x - y) > 1e-3 for x, y in zip(figures, words, strict=True)) > 50
    model = toxicity.fit(docs, labels, order=2)
    got = {r.doc_id: r.score for r in toxicity.op5_toxicity(docs.union(more), labels).collect()}
    for k, x in zip([*rows, *range(10_000, 10_000 + len(ask))], figures, strict=True):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * x))), abs=1e-5)


@pytest.mark.parametrize(("data", "least"), [("/root/testdata/sf0.01", 0.85), ("/root/testdata/sf0.1", 0.94)])
def test_toxicity_on_the_tables(spark, data, least):
    if not os.path.isdir(data):
        pytest.skip("no driver tables")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = toxicity.op5_toxicity(docs, labels).toPandas().merge(labels.select("doc_id", "toxic").toPandas(), on="doc_id")
    held = got[got.held_out]
    print(data, "AUC", auc(held.toxic, held.score), "precision", held.toxic[held.predicted == 1].mean(), "recall", held.predicted[held.toxic == 1].mean())
    assert auc(held.toxic, held.score) > least


def test_copies_have_their_majority_label(spark):
    """Each text five times, and the copy with the smallest id has the wrong label."""
    docs, labels = marked(spark, 150)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    ids = (k for k in range(1000, 9000) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows, marks = [], []
    for r in docs.orderBy("doc_id").collect():
        for copy in range(5):
            k = next(ids)
            rows.append((k, *r[1:]))
            marks.append((k, 0, toxic[r.doc_id] ^ int(copy == 0)))
    copies, wrong = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.scored(copies, wrong).toPandas().set_index("doc_id").score
    truth = [toxic[k] for k in sorted(toxic) for _ in range(5)]
    assert auc(truth, [got[r[0]] for r in rows]) > 0.9


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_toxicity_counts_shuffle_only_texts_whose_ids_share_a_place(spark, size):
    """Whatever the size of the map, the counts are those of a join by the id, with repeated and null ids and ids that are marked twice."""
    docs = spark.createDataFrame([(k, f"a{k} b{k % 7} c{k % 3}") for k in range(300)] + [(5, "other text"), (None, "without an id")], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2, k % 5 // 4) for k in range(0, 300, 3)] + [(6, 1, 1), (9999, 1, 0)], "doc_id long, toxic int, curve int")
    counted, shuffled = toxicity._counted(docs, marks, size)
    sums = lambda df: sorted(map(tuple, df.groupBy("word", "of").agg({"n": "sum"}).collect()))
    texts = docs.join(marks, "doc_id").selectExpr("toxic * 2 + curve kind", "text")
    assert sums(counted) == sums(texts.mapInArrow(toxicity._word_pairs, "word long, of long, n long"))
    assert shuffled.count() > 200 if size == 64 else shuffled.count() < 10  # before, all that are marked


@pytest.mark.parametrize("operator", [quality.op1_quality, toxicity.op5_toxicity])
def test_nothing_to_learn_from(spark, operator):
    docs, labels = marked(spark, 9)
    none = labels.limit(0)
    assert {r.score for r in operator(docs, none).collect()} == {0.5}
    assert operator(docs.limit(0), labels).count() == 0
    assert operator(docs.union(docs), labels.union(labels)).count() == 18
    odd = labels.selectExpr("cast(null as long) doc_id", "quality", "toxic").union(labels.selectExpr("doc_id + 100000", "quality", "toxic")).union(labels.selectExpr("doc_id", "cast(null as int)", "cast(null as int)"))
    assert operator(docs, odd).count() == 9


def test_empty_and_very_long_texts_have_scores(spark):
    docs, labels = marked(spark, 60)
    odd = spark.createDataFrame([(5001, None, None, "s", "x"), (5002, "", None, "s", "x"), (5003, " \n", None, "s", "x"), (5004, "word " * 400_000, None, "s", "x"), (5004, "w" * 1_500_000, None, "s", "x")], DOCS)
    got = [r.score for r in quality.scored(docs.union(odd), labels).where("doc_id > 5000").collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for s in got)
    got = [r.score for r in toxicity.scored(docs.union(odd), labels).where("doc_id > 5000").collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for s in got)
    kept = quality.accepted(docs.union(odd), labels)
    assert kept.schema == docs.schema


def test_attention_gradients():
    """The way back against differences."""
    rng = np.random.default_rng(4)
    h, g = 3, 2
    w = {"W": rng.normal(size=(4, h)), "b": rng.normal(size=h), "V": rng.normal(size=(h, g)), "U": rng.normal(size=(h, g)), "a": rng.normal(size=g), "c": rng.normal(size=h), "d": rng.normal(size=1)}
    x, head, y = rng.normal(size=(6, 4)), np.array([0, 1, 4, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        z, _ = quality._forward(w, x, head)
        return np.sum(np.logaddexp(0, z) - y * z)

    z, kept = quality._forward(w, x, head)
    grads = quality._backward(w, x, head, kept, 1 / (1 + np.exp(-z)) - y)
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            down = loss()
            value[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_long_texts_in_blocks_give_the_same(monkeypatch):
    """What is done block by block for a very long text, against all at once."""
    import pyarrow as pa

    from quire.llm import common

    rng = random.Random(9)
    texts = ["", *[" ".join("".join(rng.choice("abcÄß .!") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (300, 0, 1, 80)], "x" * 500 + " y"]
    (_, _, raw, offsets), = common.pieces(pa.array(texts))
    model = language.Model(["a", "b", "c"], np.log(np.random.default_rng(1).random((language.BUCKETS, 3))).astype(np.float32))
    starts, ends = common.runs(common.WORD[common.LOWER[raw]], offsets)
    shuffled = np.random.default_rng(2).permutation(len(starts))

    def results():
        x, head = quality._encoded(raw, offsets)
        hashes = common.span_hashes(raw, starts, ends)
        assert (common.span_hashes(raw, starts[shuffled], ends[shuffled]) == hashes[shuffled]).all()
        return x, head, hashes, model.mixtures(raw, offsets)

    whole = results()
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    monkeypatch.setattr(quality, "PIECE_BYTES", 64)
    monkeypatch.setattr(language, "FIGURES", 1)
    monkeypatch.setattr(language, "blocks", lambda member, size: common.blocks(member, 50))
    for a, b in zip(whole, results(), strict=True):
        assert np.allclose(a, b, atol=1e-6)
    assert [b - a >= 50 or b == len(raw) for a, b in common.blocks(common.LETTER[common.LOWER[raw]], 50)]
