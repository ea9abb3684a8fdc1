"""Operators whose results are fixed, against SQL and brute force, and their edge cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, decontaminate, licenses, mixing, neardup, pii, queries, simhash, topk
from tests.llm.helpers import DATA, duck, have_data, rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, copy_no int"


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, None, source, None, "clash", 7) for k, t in texts], DOCS)


@pytest.mark.skipif(not have_data(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    want = duck().execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# Personal data


def personal(text):
    """Base spans by the contract's patterns: (kind, start, end)."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


TRICKY = [
    None, "", "a@b.com.x@y.org", "a@b.c+x@y.z", "a@b@c.d", "é@x.de, über mail x.y@z-w.co.uk!", "1.2.3.4.5 300.1.2.3 0255.255.255.255 1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112 5500005555555559",
    "+49 (0) 30-1234567. +1 2", "+1+1+123456789", "\x00a@b.cd\x00 +49 30 123456789", "12  34 4111111111111111 9", "日本 4111111111111111 a@b.cd 10.0.0.1", "x" * 3000 + "@" + "y" * 3000, "1" * 5000, "1 " * 3000,
]


def test_personal_data_against_patterns(spark):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice("ab1234567890  .-+@()") for _ in range(rng.randrange(200))) for _ in range(200)]
    got = {r.doc_id: r for r in pii.op8_personal_data(documents(spark, enumerate(texts))).collect()}
    for k, text in enumerate(texts):
        spans = personal(text)
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (k, text[:80], joined, got[k].spans)
        assert [got[k][f"n_{n}"] for n in ("email", "ip", "card", "phone")] == [sum(s[0] == n for s in spans) for n in ("email", "ip", "card", "phone")]


def test_personal_data_of_nothing_repeats_and_long_texts(spark):
    assert pii.op8_personal_data(documents(spark, [])).count() == 0 and pii.redact(documents(spark, [])).count() == 0
    long = "".join(f"w{k} a{k}@b.cd 10.0.{k % 300}.1 " for k in range(700)) + "x" * 20_000 + " 4111 1111 1111 1111"
    got = pii.op8_personal_data(documents(spark, [(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd"), (2, long)])).collect()
    assert [r.n_email for r in got if r.doc_id != 2] == [1, 1, 1]
    joined = ",".join(f"{a}:{b}:{c}" for a, b, c in personal(long))
    assert next(r.base_sha256 for r in got if r.doc_id == 2) == hashlib.sha256(joined.encode()).hexdigest()


def test_redaction_leaves_the_rest_alone(spark):
    odd = ["a\0b", "\x01\x02 \0", "\x01", "\0mail a@b.cd\0\x01\x03", None, ""]
    got = {r.doc_id: r.text for r in pii.redact(documents(spark, enumerate(odd))).collect()}
    assert [got[k] for k in range(len(odd))] == [*odd[:3], "\0mail [EMAIL]\0\x01\x03", None, ""]


@pytest.mark.parametrize("of", [lambda n: "mail a@b.cd now " * n])
def test_personal_data_takes_linear_time(spark, of):
    took = []
    for n in (4000, 8000, 16000):
        df = documents(spark, [(1, of(n))])
        pii.op8_personal_data(df).collect()
        start = time.monotonic()
        pii.op8_personal_data(df).collect()
        took.append(time.monotonic() - start)
    assert took[2] < 2.5 * took[1] + 0.5 and took[1] < 2.5 * took[0] + 0.5, took


def test_checksums_context_and_redaction(spark):
    docs = documents(spark, [(1, "my iban GB82 WEST 1234 5698 7654 32, not GB82 WEST 1234 5698 7654 33"), (2, "ssn 123-45-6789 and 666-45-6789"), (3, "mail a@b.cd or 4111 1111 1111 1111"), (None, None)])
    found = {r.doc_id: r for r in pii.op8_personal_data(docs).collect()}
    assert (found[1].n_iban, found[2].n_ssn, found[3].n_email, found[3].n_card, found[None].spans) == (1, 1, 1, 1, "")
    assert found[3].n_confident == 1 and found[1].n_confident == 1
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    text = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert text[3] == ("mail [EMAIL] or [CARD]", 22) and text[None] == (None, None)
    assert text[1][0].startswith("my iban [IBAN], not GB82")


# SimHash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, distance):
    """Smallest id that each one's links reach."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    known = sorted(set(fps))
    for k, a in enumerate(known):
        for b in known[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        least[find(f)] = min(i, least.get(find(f), i))
    return [least[find(f)] for f in fps]


def test_fingerprints_and_components(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["ab", "cd", "É", "Xy", "z"]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 60, 300)]
    texts = [None, "  \t\n", *base, *[b.upper() for b in base], *[b + " tail" for b in base], *[b.replace("ab", "aB", 2) for b in base]]
    got = {r.doc_id: r for r in simhash.op6_simhash_near_dedup(documents(spark, enumerate(texts))).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[k].component_id for k in range(len(texts))] == components(range(len(texts)), fps, 4)


def test_links_of_a_hot_key_lose_nothing(spark):
    """Many fingerprints that share most blocks, with chunks far smaller than their group."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(250):
        f = centre
        for b in rng.sample(range(40), rng.randrange(9)):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(nodes, chunk=16)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 64).count() == 0
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    mine = [root.get(f, f) for f in signed]
    want = components(range(len(fps)), fps, 4)
    same = lambda x: [[a == b for b in x] for a in x]
    assert same(mine) == same(want)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_small_tables_are_few_files(spark):
    """However many partitions a shuffle has: on a local file system each file costs two processes, started from the executor."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
        roots = simhash.components(edges)
        assert roots.rdd.getNumPartitions() <= 4 and {r.root for r in roots.collect()} == {0}
        texts = spark.createDataFrame([(k, "one two three four five six seven" + " eight" * (k % 2)) for k in range(40)], "node long, text string")
        pairs = neardup.verified(edges.where("b < 40").distinct(), texts, similarity=0.7)
        assert pairs.rdd.getNumPartitions() <= 4 and pairs.count() == 39
        marked = common.maybe_marked(texts, edges.select(F.col("a").alias("node")), "node", neardup._sets(5), "node long, s binary")
        assert marked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one Python worker for each task
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)



def test_fingerprints_of_long_texts(monkeypatch):
    rng = random.Random(13)
    texts = [" ".join("".join(rng.choice("abÄ") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 40, 200)] + ["x" * 300 + "\t\n y", "  \n", " a  b " * 30]
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 16)
    monkeypatch.setattr(simhash._word_blocks, "__defaults__", (16,))
    assert [simhash.fingerprint(t.encode()) for t in texts] == [fingerprint(t) for t in texts]


def test_fingerprints_of_no_documents(spark):
    assert simhash.op6_simhash_near_dedup(documents(spark, [])).count() == 0


# Near duplicates by similarity


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_representatives_decide_row_by_row(spark):
    same = "one two three four five six seven"
    other = "something else entirely goes here now"
    docs = documents(spark, [(5, same), (5, other), (9, other.upper()), (9, other), (None, same), (None, "only without an id"), (None, "only  without an ID"), (7, None), (8, ""), (-3, "three  words only")])
    docs = docs.withColumn("fp", F.lit(1)).withColumn("Row", F.lit(2)).withColumn("a.b", F.lit(3))
    kept = neardup.representatives(docs)
    assert kept.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert [g for g in got if g[0] is not None] == [(-3, "three  words only"), (5, same), (5, other), (7, None)]
    assert len([g for g in got if g[0] is None]) == 1
    assert neardup.representatives(docs.limit(0)).count() == 0


def edited(rng, words, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


def test_representatives_against_shingle_similarity(spark):
    """Copies far above 0.8 go, texts far below stay, and a dense group larger than its chunks is one group."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(150, 400))] for _ in range(40)]
    near = [(100 + k, " ".join(b[:-1] + ["tail"])) for k, b in enumerate(base[:20])]
    far = [(200 + k, " ".join(edited(rng, b, 0.2, vocabulary))) for k, b in enumerate(base)]
    crowd = [(300 + k, " ".join(edited(rng, base[0], 0.004, vocabulary))) for k in range(150)]
    rows_ = [(k, " ".join(b)) for k, b in enumerate(base)] + near + far + crowd
    for i, t in near:
        assert similarity(t, rows_[i - 100][1]) > 0.9
    for i, t in far:
        assert similarity(t, rows_[i - 200][1]) < 0.6
    for chunk in (16, 4096):
        kept = sorted(r.doc_id for r in neardup.representatives(documents(spark, rows_), chunk=chunk).collect())
        assert kept == list(range(40)) + [i for i, _ in far]


def test_representatives_at_the_threshold(spark):
    """Every pair at 0.8 or just above is a pair of copies, none just below is."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    rows_, gone = [], []
    for k in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        other = list(base)
        above = k % 2 == 0
        while True:  # words are changed as long as the similarity stays above, or until it is below
            tried = list(other)
            tried[rng.randrange(len(tried))] = "new" + rng.choice(vocabulary)
            near = similarity(" ".join(base), " ".join(tried)) >= 0.8
            if above and not near:
                break
            other = tried
            if not near:
                break
        rows_ += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        gone += [2 * k + 1] if above else []
    kept = {r.doc_id for r in neardup.representatives(documents(spark, rows_)).collect()}
    assert set(range(300)) - kept == set(gone)


@pytest.mark.parametrize(("n", "chunk"), [(600, 4096), (150, 16)])
def test_texts_just_below_the_similarity_make_no_square_of_pairs(spark, monkeypatch, n, chunk):
    """Edited copies of one text, mostly below 0.8 from each other: their links are found, and no table has a row for each pair."""
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    base, rows_ = [rng.choice(vocabulary) for _ in range(250)], []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(250), rng.choice([4, 5, 6, 7, 8])):
            words[at] = f"new{rng.random()}"
        rows_.append((k, " ".join(words)))
    sets, root = [shingles(t) for _, t in rows_], list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = [(a, b) for b in range(n) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {k for k in range(n) if root[k] == k}
    assert 1 < len(want) < n and len(pairs) < n * n / 8
    made, gathered = [], neardup.gathered

    def counted(df, dealt=False):
        out = gathered(df, dealt)
        made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "gathered", counted)
    monkeypatch.setattr(neardup, "ROUNDS", 0)  # what the early blocks join up is left to the areas, too
    assert {r.doc_id for r in neardup.representatives(documents(spark, rows_), chunk=chunk).collect()} == want
    print(n, chunk, "rows of the largest table", max(made))
    assert max(made) <= 30 * n


def test_dense_groups_lose_no_link():
    """Clusters along a chain of fingerprints, against all pairs."""
    rng = np.random.default_rng(12)
    bits = np.zeros((120, neardup.WORDS64), dtype=np.uint64)
    for k in range(1, 120):
        bits[k] = bits[k - 1]
        for b in rng.integers(0, 1024, rng.integers(1, 130)):
            bits[k, b // 64] ^= np.uint64(1 << int(b % 64))
    a, b = neardup._dense(bits, 100)
    nodes = np.arange(120)
    every = [(x, y) for x in range(120) for y in range(x) if np.bitwise_count(bits[x] ^ bits[y]).sum() <= 100]
    got = simhash._roots(120, np.array(a), np.array(b))
    want = simhash._roots(120, np.array([x for x, _ in every]), np.array([y for _, y in every]))
    assert (got == want).all() and len(a) < len(every) and len(nodes) == 120


# Decontamination


def contaminated(text, items, window):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        size = min(window, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(words) - size + 1 if size else 0):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_windows_against_brute_force(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "Ä", "x9", "the"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 4, 5, 9, 12, 4, 4])] + [(None, "a a a a"), (10, None), (2, "the x9 the")]
    texts = [None, "", "...", *[" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(60)], "A,b;C-Ä" * 50]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(documents(spark, enumerate(texts)), bench, 4, block_bytes).collect()}
    named = [i for i in items if i[0] is not None]
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, hashlib.sha256(r["items"].encode()).hexdigest()) == contaminated(text, named, 4), k


def test_clean_keeps_clean_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = documents(spark, [(1, "so Alpha, beta; GAMMA it is"), (2, "alpha beta delta"), (None, None), (3, "")])
    kept = decontaminate.clean(docs, bench)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {2, 3, None}
    assert decontaminate.clean(docs, bench.limit(0)).count() == 4
    assert decontaminate.op4_decontaminate(docs.limit(0), bench).count() == 0


# Top-k


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vectors = [(k, [float(x) for x in rng.integers(-3, 4, 6) / 7]) for k in range(120)]
    vectors += [(200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (250, [float("nan")] * 6), (300, None), (None, [1.0] * 6), (350, [1.0, 2.0]), (351, [0.5, 0.5]), (10, [1.0] * 6), (10, [1.0] * 6), (400, [float("inf")] * 6)]
    df = spark.createDataFrame([(k, v, 0) for k, v in vectors], "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, 5, 50, block=8, query_block=2, range_rows=40).orderBy("query_id", "rank").collect()]
    good = [(k, [int(np.floor(256 * x)) for x in v]) for k, v in vectors if k is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in sorted(x for x in good if x[0] % 50 == 0):
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), k) for k, b in good if k != q and len(b) == len(a))
        want += [(q, n, k, -s) for n, (s, k) in enumerate(scores[:5], 1)]
    assert got == want


def test_top_k_of_large_components_and_nothing(spark):
    df = spark.createDataFrame([(0, [2.0**30, 1.0]), (1, [2.0**12, 3.0]), (2, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(df).collect()}
    assert got == {1: 2**38 * 2**20 + 256 * 768, 2: -(2**38) * 256 + 256 * 128}
    assert topk.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1.7e308, 1.0, -1e307]), (1, [1e308, -1e308, 2.0]), (2, [-1e308, 0.0, 0.0]), (3, [0.0, 3.0, 0.0]), (50, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(huge).collect()}
    assert got[0, 1] == 2**63 - 1 and got[0, 2] == -(2**63) and got[0, 3] == 256 * 768 and got[50, 3] == 256 * 768 and len(got) == 8


def test_top_k_reads_candidates_once(spark):
    """The plan doesn't grow with the number of query blocks, and nothing is broadcast by the driver."""
    df = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(600)], "vec_id long, embedding array<double>")
    plans = [topk.top_k(df, every=2, query_block=n)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for n in (500, 10)]
    assert plans[0] == plans[1]


# Mixing


def test_targets_against_repeated_resharing(spark):
    sizes = {"b": 100, "a": 10, "c": 1000, "d": 1, "e": 0, None: 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    names = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, target, open_names = 1.5 * sum(sizes.values()), {}, set(names)
    while open_names:
        share = {s: left * weight[s] / sum(weight[x] for x in open_names) for s in open_names}
        over = {s for s in open_names if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_names -= over
    assert got == pytest.approx(target)


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(6)
    docs = documents(spark, [(k, "w " * rng.randrange(1, 80)) for k in range(3000)], "x").union(documents(spark, [(k, "w " * rng.randrange(30)) for k in range(5000, 6000)], None))
    docs = docs.union(documents(spark, [(1, None), (1, None), (None, "a b c")], "y"))
    first, again = (mixing.copies(docs, bucket_rows=n).cache() for n in (512, 64))
    key = ["doc_id", "source", "size"]
    assert rows(first.select(*key, "n_copies").toPandas()) == rows(again.select(*key, "n_copies").toPandas())  # buckets don't matter
    assert first.where("n_copies > 2").count() == 0
    for r in first.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= max(80, 0.01 * r.target)
    mixed = mixing.mixed(docs)
    assert mixed.columns == [c for c in docs.columns if c != "copy_no"] + ["copy_no"]
    assert mixed.count() == first.agg(F.sum("n_copies")).collect()[0][0]
    assert mixing.op10_mix_sources(docs.limit(0)).count() == 0


# Licences


def test_licences_and_inheritance(spark):
    files = [
        ("a/LICENSE", "The software\nLicensed under the Apache License, Version 2.0.\n"),
        ("a/b/c.py", "print(1)"),
        ("a/b/d.py", "# Released under the MIT License.\nx = 1"),
        ("ab/c.py", "no notice"),
        ("a/e/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/e/f/g.txt", ""),
        ("z/notes.txt", "we had permission to go"),
        (None, None),
        ("a/b/c.py", "print(1)"),
    ]
    df = spark.createDataFrame([(p, t, "clash") for p, t in files], "path string, text string, license string")
    got = [(r.path, r.license, r.how, r.from_dir) for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted(
        [
            ("a/LICENSE", "Apache-2.0", "notice", None),
            ("a/b/c.py", "Apache-2.0", "inherited", "a"),
            ("a/b/c.py", "Apache-2.0", "inherited", "a"),
            ("a/b/d.py", "MIT", "notice", None),
            ("ab/c.py", None, "none", None),
            ("a/e/COPYING", "GPL-3.0", "notice", None),
            ("a/e/f/g.txt", "GPL-3.0", "inherited", "a/e"),
            ("z/notes.txt", None, "none", None),
            ("", None, "none", None),
        ],
        key=str,
    )
    assert licenses.scan(df.limit(0)).count() == 0
    docs = documents(spark, [(-7, "Licensed under the MIT license"), (7, None), (None, "x"), (7, "Released under the MIT License.")])
    assert sorted((r.doc_id for r in licenses.op7_license_scan(docs).collect()), key=str) == [-7, 7, 7, None]


def test_mixed_rows_of_equal_ids_and_clashing_names(spark):
    df = documents(spark, [(1, "a b c"), (1, "d e f"), (1, "a b c"), (None, "x y z"), (None, "u v w")] + [(k, "w " * (k % 7)) for k in range(50, 90)])
    df = df.withColumns({c: F.lit("mine") for c in ("row", "whole", "_size", "size", "key", "tie", "n_copies", "Source_size", "a.b")})
    first, again = (sorted(map(tuple, mixing.mixed(x).drop("copy_no").collect()), key=str) for x in (df, df.repartition(3)))
    assert first == again and all(r.a == "mine" for r in mixing.mixed(df).select(F.col("`a.b`").alias("a")).collect())
    counts = mixing.copies(df)
    assert len(first) == counts.agg(F.sum("n_copies")).collect()[0][0]
    long = documents(spark, [(1, "w " * 300_000), (2, "w")])
    assert {r["size"] for r in mixing.copies(long).collect()} == {300_000, 1}


def test_ties_between_licences_and_paths(spark):
    """Equal scores go to the smaller path of a directory; rows of one path share their notices."""
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE-2", mit), ("a/LICENSE-1", apache), ("a/x.txt", None), ("b/y.txt", mit), ("b/y.txt", "nothing"), ("/z.txt", "")]
    got = sorted(((r.path, r.license, r.how, r.from_dir) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()), key=str)
    assert got == [("/z.txt", None, "none", None), ("a/LICENSE-1", "Apache-2.0", "notice", None), ("a/LICENSE-2", "MIT", "notice", None), ("a/x.txt", "Apache-2.0", "inherited", "a"), ("b/y.txt", "MIT", "notice", None), ("b/y.txt", "MIT", "notice", None)]


def test_words_around_a_notice_do_not_dilute_it(spark):
    """A licence sentence in a long line, across line ends, and at the end of a very long text; prose about permission is none."""
    prose = " ".join(f"word{k}" for k in range(400))
    files = [
        ("a/1.js", f"{prose} Released under the MIT License. {prose}"),
        ("b/2.js", "/* Licensed under the\n * Apache License,\n * Version 2.0. */" + prose),
        ("c/3.txt", "x " * 300_000 + "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        ("d/4.txt", f"{prose} they had permission to go and asked for a license for the dog {prose}"),
        ("e/5.txt", f"{prose}\rReleased under the MIT License."),
        ("f/6.txt", "permission"),
    ]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/1.js": "MIT", "b/2.js": "Apache-2.0", "c/3.txt": "MPL-2.0", "d/4.txt": None, "e/5.txt": "MIT", "f/6.txt": None}


def test_plans_of_native_operators_have_no_python(spark):
    docs = documents(spark, [(1, "a@b.cd Licensed under the MIT license")])
    for df in (pii.op8_personal_data(docs), pii.redact(docs), licenses.op7_license_scan(docs), mixing.op10_mix_sources(docs), mixing.mixed(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
