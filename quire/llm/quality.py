"""Quality classifier: gated attention over a document's passages, learned from document labels.

Every ``PASSAGE`` words of a text are a passage. Its encoding is a vector of plain figures
(kinds of bytes, word shapes, repetition) and hashed byte pairs; a learned layer turns that
into a hidden vector. Gated attention (a tanh gate times a sigmoid gate, softmax over the
document's passages) weighs the hidden vectors, and a logistic unit scores their weighted sum.

Passages are encoded on the executors. The model is fitted on the driver, on at most
``SAMPLE`` labelled documents, those whose hashed ids come first, and at most ``FIT_PASSAGES``
passages of each, evenly spread over it, so the bound holds at any size and any length. Scoring
runs over whole texts, and only the model (some 100 kB) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LETTER, LOWER, NONSPACE, PIECE_BYTES, pieces, remainder, row_counts, runs, span_hashes
from quire.runtime import map_arrow

PASSAGE = 64
#: Most labelled documents that the model is fitted on.
SAMPLE = 6000
#: Most passages of such a document that the model is fitted on; 6,000 x 64 are 135 MB.
FIT_PASSAGES = 64
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 7
THRESHOLD = 0.3
#: Held out: crc32(doc_id) mod FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 5, 0
PAIRS = 128

#: Kinds of bytes: each ASCII sign has its own, other bytes are upper, lower, digit, space, line end, control or non-ASCII.
_KIND = np.zeros(256, dtype=np.int64)
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KIND[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 2
_KIND[[ord(c) for c in "0123456789"]] = 3
_KIND[32] = 4
_KIND[[10, 13]] = 5
_KIND[128:] = 6
for _k, _b in enumerate(_SIGNS):
    _KIND[_b] = 7 + _k
N_KINDS = 7 + len(_SIGNS)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
N_FIGURES = 9
N_FEATURES = N_KINDS + N_FIGURES + PAIRS


def _encoded(raw: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of some texts, and each text's first passage. A text without words has one passage of zeros."""
    starts, ends = runs(NONSPACE[raw], offsets)
    first = row_counts(starts, offsets)
    words = np.diff(first)
    n_passages = np.maximum(1, -(-words // size))
    head = np.concatenate(([0], np.cumsum(n_passages)))
    n = int(head[-1])
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    if not len(starts):
        return x, head
    text = np.repeat(np.arange(len(words)), words)
    passage = head[text] + (np.arange(len(starts)) - first[text]) // size
    count = np.bincount(passage, minlength=n).astype(np.float32)
    # Bytes from a passage's first word up to the next passage's belong to it; those before a text's first word to the passage before.
    opens = np.searchsorted(passage, np.arange(n))
    has = count > 0
    order = np.flatnonzero(has)
    cuts = starts[opens[order]]
    low = LOWER[raw]
    kinds, pairs, n_bytes = np.zeros((n, N_KINDS), np.float32), np.zeros((n, PAIRS), np.float32), np.zeros(n, np.float32)
    for a in range(0, len(raw), PIECE_BYTES):  # more than once only for a very long text
        some = slice(a, a + PIECE_BYTES)
        of = order[np.maximum(np.searchsorted(cuts, np.arange(a, min(a + PIECE_BYTES, len(raw))), side="right") - 1, 0)]
        opening = int(of[0])
        of, m = of - opening, int(of[-1]) - opening + 1
        rows = slice(opening, opening + m)
        n_bytes[rows] += np.bincount(of, minlength=m)
        kinds[rows] += np.bincount(of * N_KINDS + _KIND[raw[some]], minlength=m * N_KINDS).reshape(m, N_KINDS)
        here, behind = low[some], low[a + 1 : a + 1 + PIECE_BYTES]
        pair = (here[: len(behind)].astype(np.uint32) * 31 + behind.astype(np.uint32) * 1009) % 8191 % PAIRS
        pairs[rows] += np.bincount(of[: len(behind)] * PAIRS + pair, minlength=m * PAIRS).reshape(m, PAIRS)
    n_bytes = np.maximum(n_bytes, 1)[:, None]
    x[:, :N_KINDS], x[:, N_KINDS + N_FIGURES :] = kinds / n_bytes, pairs / n_bytes
    hashes = span_hashes(low, starts, ends)
    length = (ends - starts).astype(np.float32)
    inner = LETTER[low[ends - 1]]
    same_text = text[1:] == text[:-1]
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = same_text & (hashes[1:] == hashes[:-1])

    def seen_before(keys: np.ndarray) -> np.ndarray:
        """Whether the same key stands earlier in the same text."""
        by = np.argsort(keys, kind="stable")
        before = np.zeros(len(keys), dtype=bool)
        before[by[1:]] = keys[by[1:]] == keys[by[:-1]]
        return before

    with np.errstate(over="ignore"):
        own = hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        known = seen_before(own)
        three = own.copy()
        three[2:] = own[2:] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[:-2] * np.uint64(7)
    repeated = seen_before(three)
    repeated[:2] = False
    figures = [
        length / 10,
        (length > 12).astype(np.float32),
        _UPPER[raw[starts]],
        _UPPER[raw[ends - 1]],
        inner,
        again,
        known,
        repeated,
    ]
    for k, values in enumerate(figures):
        x[:, N_KINDS + k] = np.bincount(passage, weights=values, minlength=n) / np.maximum(count, 1)
    x[:, N_KINDS + 8] = count / size
    return x, head


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, head: np.ndarray) -> np.ndarray:
        z, _ = _forward(self.weights, (x - self.mean) * self.scale, head)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Logits of texts whose passages are x[head[k]:head[k+1]], and what the way back needs."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * s) @ w["a"]
    text = np.repeat(np.arange(len(head) - 1), np.diff(head))
    e = np.exp(e - np.maximum.reduceat(e, head[:-1])[text])
    attention = e / np.add.reduceat(e, head[:-1])[text]
    m = np.add.reduceat(attention[:, None] * h, head[:-1], axis=0)
    return m @ w["c"] + w["d"][0], {"h": h, "t": t, "s": s, "attention": attention, "m": m, "text": text}


def _backward(w: dict[str, np.ndarray], x: np.ndarray, head: np.ndarray, k: dict[str, np.ndarray], dz: np.ndarray) -> dict[str, np.ndarray]:
    h, t, s, p, text = k["h"], k["t"], k["s"], k["attention"], k["text"]
    g = {"c": k["m"].T @ dz, "d": np.array([dz.sum()], dtype=dz.dtype)}
    dm = dz[:, None] * w["c"]
    dh = p[:, None] * dm[text]
    dp = (h * dm[text]).sum(axis=1)
    de = p * (dp - np.add.reduceat(p * dp, head[:-1])[text])
    g["a"] = (t * s).T @ de
    dgate = de[:, None] * w["a"]
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(axis=0)
    return g


def _trained(bags: list[np.ndarray], labels: np.ndarray, seed: int) -> Model:
    """Adam on the logistic loss of document labels."""
    rng = np.random.default_rng(seed)
    n, sums = sum(map(len, bags)), [sum(b.astype(np.float64).__pow__(k).sum(axis=0) for b in bags) for k in (1, 2)]
    mean = (sums[0] / n).astype(np.float32)
    scale = (1 / (np.sqrt(np.maximum(sums[1] / n - (sums[0] / n) ** 2, 0)) + 1e-3)).astype(np.float32)

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"W": start(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": start(HIDDEN, GATE), "U": start(HIDDEN, GATE), "a": start(GATE), "c": start(HIDDEN), "d": np.zeros(1, np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            x = (np.concatenate([bags[k] for k in some]).astype(np.float32) - mean) * scale
            head = np.concatenate(([0], np.cumsum([len(bags[k]) for k in some])))
            z, kept = _forward(w, x, head)
            dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)).astype(np.float32)
            step += 1
            for name, g in _backward(w, x, head, kept, dz).items():
                g = g + DECAY * w[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] = w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _spread(bag: np.ndarray, most: int = FIT_PASSAGES) -> np.ndarray:
    return bag if len(bag) <= most else bag[np.arange(most) * len(bag) // most]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in pieces(batch.column(1)):
            x, head = _encoded(raw, offsets)
            bags = [_spread(x[head[k] : head[k + 1]]).astype(np.float16).tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(bags, type=pa.binary())], ["key", "bag"])


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model:
    """A model from at most ``sample`` documents with labels.quality, none of them held out.

    Labels that are null or of no document are ignored; of several labels of a document the
    largest counts, and of several texts of a doc_id the one whose hash is the smallest. With no
    label at all every text gets the score 0.5.
    """
    some = (
        labels.where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # ``sample`` rows at most
    bags = map_arrow(texts.select(F.struct("doc_id", "label", F.xxhash64("text").alias("h")).alias("key"), "text"), _encode, "key struct<doc_id:long,label:int,h:long>, bag binary")
    one = bags.groupBy("key.doc_id").agg(F.min(F.struct("key.h", "bag", "key.label")).alias("x"))
    rows = one.select("x.bag", "x.label").toArrow()
    order = sorted(zip(rows.column("bag").to_pylist(), rows.column("label").to_pylist(), strict=True))
    del rows
    if not order:
        zero = {"W": (N_FEATURES, 1), "b": (1,), "V": (1, 1), "U": (1, 1), "a": (1,), "c": (1,), "d": (1,)}
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), {k: np.zeros(v, np.float32) for k, v in zero.items()})
    bags = [np.frombuffer(b, dtype=np.float16).reshape(-1, N_FEATURES) for b, _ in order]
    return _trained(bags, np.array([y for _, y in order], dtype=np.float32), seed)


def _scored(shared, at: int, keep_all: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for a, b, raw, offsets in pieces(batch.column(at)):
                scores[a:b] = model.scores(*_encoded(raw, offsets))
            if keep_all:
                yield batch.filter(pa.array(scores >= THRESHOLD))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return score


def scored(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id and score, from 0 to 1.

    A null or empty text has one empty passage and gets that one's score. Null and repeated
    doc_ids are rows like others; labels, lang, source and doc_id are no inputs of a score.
    Texts of any length are scored whole. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample))
    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), _scored(shared, 1, False), "doc_id long, score double")


def op1_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(documents, labels)
    return found.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents``, all their columns, with a score of at least ``THRESHOLD``; nothing is shuffled.

    Rows are judged one by one, as ``scored`` has it for nulls, empty and long texts and repeated rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample))
    return map_arrow(documents, _scored(shared, documents.columns.index("text"), True), documents.schema)
