"""The pipeline against its stages done by hand on a small input, and its contract."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline as cp
from quire.llm import mixing, quality
from tests.llm.test_exact import contaminated, personal, similarity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    docs = [(k, prose(rng.randrange(20, 90))) for k in range(120)]
    docs += [(200 + k, " ".join(w.upper() + "!!" for w in prose(40).split())) for k in range(60)]
    docs += [(300 + k, docs[k][1]) for k in range(10)] + [(320 + k, docs[k][1] + " end") for k in range(10)]
    item = prose(14)
    docs += [(400 + k, prose(30) + " " + item + " " + prose(10)) for k in range(5)]
    docs += [(500 + k, prose(20) + f" mail me{k}@mail.org or 4111 1111 1111 1111 now " + prose(9)) for k in range(5)]
    docs += [(600, None), (601, "")]
    labels = [(k, int(k < 200 or k >= 300), 0) for k, _ in docs if k < 600]
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "never to be found anywhere in here at all my friend")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, [(1, item)]


def test_stages_against_hand_made_ones(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.op1_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = [r for r in rows if scores[r[0]] >= quality.THRESHOLD]
    assert {r[0] for r in kept if r[0] < 200} == set(range(120)) and not [r for r in kept if 200 <= r[0] < 300]
    kept = [r for k, r in enumerate(kept) if not any(similarity(r[1], o[1]) >= 0.8 for o in kept[:k])]
    kept = [r for r in kept if not contaminated(r[1], items, 10)[1]]
    assert not {400, 401, 300, 301} & {r[0] for r in kept}

    def masked(text):
        for kind, a, b in sorted(personal(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        return text

    kept = [(r[0], masked(r[1]), *r[2:4], None if r[1] is None else len(masked(r[1]))) for r in kept]
    state = docs
    for name, stage in cp.STAGES[:-1]:
        state = stage(spark, state, folder)
        assert state.columns == docs.columns, name
    assert sorted(map(tuple, state.collect()), key=str) == sorted(kept, key=str)
    made = spark.createDataFrame(kept, DOCS)
    want = {r.doc_id: r.n_copies for r in mixing.copies(made).collect() if r.n_copies}
    got = {r.doc_id: r["count"] for r in cp.run(spark, folder).groupBy("doc_id").count().collect()}
    assert got == want


def test_contract(spark, corpus):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "mixing sources"]
    assert cp.ORACLE_SQL is None
    out = cp.run(spark, corpus[0])
    assert out.where(F.col("text").rlike("@mail|4111")).count() == 0 and out.agg(F.max("copy_no")).collect()[0][0] <= 2


def test_repeated_ids_and_clashing_columns(spark, corpus, tmp_path):
    """Rows of one id with different texts are rows like others, and a caller's columns come through."""
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.where("doc_id IN (1, 2)").withColumn("doc_id", F.lit(3).cast("long"))
    clash = {c: F.lit("mine") for c in ("_size", "size", "row", "fp", "score", "n_hit", "key", "whole")}
    both = docs.where("doc_id NOT IN (1, 2)").union(more).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).withColumns(clash)
    both.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    state = both
    for _, stage in cp.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
    assert {r.text for r in state.where("doc_id = 3").collect()} == {r[1] for r in rows if r[0] in (1, 2, 3)}
    out = cp.run(spark, str(tmp_path))
    assert out.columns == [*both.columns, "copy_no"] and {r._size for r in out.collect()} == {"mine"}


def test_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
