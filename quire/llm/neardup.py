"""Near-duplicate documents at a stated similarity of word shingles, by wide SimHash fingerprints.

The share of differing fingerprint bits estimates the angle between two sets of shingles; sets with
a Jaccard similarity s of equal size have the cosine 2s / (1 + s). 64 bits are too few to tell 0.8
from 0.7, and so few of such pairs differ in 4 bits or less that blocks of 64 bits find hardly any.
Here a fingerprint has 1,024 bits, over a text's different shingles, and only proposes pairs:

1. Texts become fingerprints (vectorised Python over Arrow); equal fingerprints are one node.
2. Dense groups first: nodes that share one of a few blocks of 24 bits meet, large groups in
   chunks. Within a group a spanning forest of the near ones is found, and its edges are checked.
3. Then nodes meet under ``KEYS`` samples of 20 bits each. Every pair that isn't connected yet and
   whose distance a similarity of 0.8 can have, six standard deviations of it included, is checked.
   Under a key with more than ``DENSE`` such pairs a node no pairs are made: a forest of what is near
   there gives areas, and an area's sets of shingles meet in one task, or in chunks of it two by two.
   The first ``AHEAD`` samples give most areas, so that the others hardly see their nodes again.
4. A check compares the two sets of shingles; links are pairs at the similarity or above, no others.
5. Components as in ``simhash``; the group's smallest document stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quire.llm.common import LOWER, NONSPACE, free_name, maybe_marked, mix64, pieces, row_counts, runs, span_hashes
from quire.llm.simhash import _roots, components
from quire.runtime import checkpointed, gathered, map_arrow

SHINGLE = 5
SIMILARITY = 0.8
WORDS64 = 16
BYTES = 8 * WORDS64
CHUNK = 4096
#: Blocks of three bytes whose links are joined up at a time, before other pairs are looked for, and how often.
EARLY, ROUNDS = 12, 3
#: Each of ``TABLES`` orders of a fingerprint's bits is cut into samples of ``KEY_BITS``.
KEY_BITS, TABLES = 20, 4
KEYS = 8 * BYTES // KEY_BITS * TABLES
#: Standard deviations of a distance that are allowed for.
SPREAD = 6
#: Of the 64 bits that nodes carry to their keys, as many may differ in a pair that is looked at more closely.
SKETCH = 23
#: Pairs for each row of a key above which its rows go to an area and aren't made pairs.
DENSE = 2
AHEAD = 24
#: Differing bits up to which nodes under a dense key are put into one area. Unrelated texts have 512, give or take 16; what is
#: alike, but not enough for a link, would else come up under key after key.
AREA_BITS = 384
#: Bytes of sets in a chunk of an area, about.
AREA_BYTES = 8 << 20
#: Rows that a task gathers before it looks for links; whole groups only.
FLUSH_ROWS = 50_000
#: Groups up to this size are compared row by row, all groups at once.
SMALL = 48

_U64 = np.uint64
_SALTS = mix64(np.arange(1, WORDS64 + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_PLACES = np.arange(3 * EARLY * ROUNDS).reshape(-1, 3)
#: The bits of each sample.
_SAMPLES = np.concatenate([np.argsort(mix64(np.arange(8 * BYTES, dtype=_U64) + _U64(8 * BYTES * (k + 1))))[: KEYS // TABLES * KEY_BITS].reshape(-1, KEY_BITS) for k in range(TABLES)])


def most_bits(similarity: float) -> int:
    """Differing bits that two sets of this Jaccard similarity are expected to have."""
    return int(8 * BYTES * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)


def farthest_bits(similarity: float) -> int:
    """Differing bits that hardly any two sets of this similarity exceed."""
    most = most_bits(similarity)
    return most + math.ceil(SPREAD * math.sqrt(most * (1 - most / (8 * BYTES))))


def _shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of some texts, and each text's first one. Words are as op6 has them."""
    low = LOWER[raw]
    starts, ends = runs(NONSPACE[low], offsets)
    words = span_hashes(low, starts, ends)
    first = row_counts(starts, offsets)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(1, n_words - size + 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[text]
    last = first[text + 1] if len(text) else at
    hashes = np.zeros(len(text), dtype=_U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            word = np.where(at + k < last, words[np.minimum(at + k, max(0, len(words) - 1))], _U64(0)) if len(words) else hashes
            hashes = mix64(hashes * _U64(0x9E3779B97F4A7C15) + word + _U64(k + 1))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(n) + 1))


def _summed(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints, as bytes, of texts whose shingles are hashes[first[k]:first[k + 1]]."""
    out = np.zeros((len(first) - 1, BYTES), dtype=np.uint8)
    for text in np.flatnonzero(np.diff(first)).tolist():
        ones, end = np.zeros(8 * BYTES, dtype=np.int64), int(first[text + 1])
        for a in range(int(first[text]), end, 255):  # what a byte can count
            bits = np.unpackbits(mix64(hashes[a : min(a + 255, end), None] + _SALTS).view(np.uint8), axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
        out[text] = np.packbits(2 * ones > end - first[text], bitorder="little")
    return out


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of some texts, a row of bytes each; of texts without words, zeros."""
    return _summed(*_shingles(raw, offsets, shingle))


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * BYTES
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BYTES)


def _with_fingerprints(at: int, shingle: int, name: str):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, BYTES), dtype=np.uint8)
            for a, b, raw, offsets in pieces(batch.column(at)):
                found[a:b] = fingerprints_of(raw, offsets, shingle)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(found)], [*batch.schema.names, name])

    return add


def _keys(first: int):
    """(key, node, root): the numbers and the 24 bits of ``EARLY`` blocks."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = _bytes(batch.column(1))[:, _PLACES[first : first + EARLY]].astype(np.int64)
                found = np.arange(EARLY) << 24 | parts[..., 0] << 16 | parts[..., 1] << 8 | parts[..., 2]
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *[pa.array(np.repeat(batch.column(k).to_numpy(), EARLY)) for k in (0, 2)]], ["key", "node", "root"])

    return keys


def _sampled(first: int, end: int):
    """(key, node, root, sketch): the numbers and the bits of some samples, and 64 bits of the fingerprint."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = _bytes(batch.column(1))
                bits = np.unpackbits(rows, axis=1, bitorder="little")
                found = np.tile(np.arange(first, end) << KEY_BITS, (len(rows), 1))
                for k in range(KEY_BITS):
                    found |= bits[:, _SAMPLES[first:end, k]].astype(np.int64) << k
                others = (batch.column(0).to_numpy(), batch.column(2).to_numpy(), rows.view(_U64)[:, 0].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *[pa.array(np.repeat(x, end - first)) for x in others]], ["key", "node", "root", "sketch"])

    return sampled


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b): nodes of one key, which stand together, that have different roots and like sketches; pairs have the key -1.

    A key with more than ``DENSE`` pairs a row gives its rows (key, node, root), so that what comes out grows with the rows.
    """

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, node, root = rows[:3]
        sketch = rows[3].view(_U64)
        group = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
        most = DENSE * np.bincount(group)
        found = np.zeros(len(most), dtype=np.int64)
        left, right = [], []
        first = np.arange(len(key))  # rows that still have a row of their key ``gap`` behind them
        gap = 1
        while True:
            first = first[: np.searchsorted(first, len(key) - gap)]
            first = first[key[first] == key[first + gap]]
            if not len(first):
                break
            close = first[(root[first] != root[first + gap]) & (np.bitwise_count(sketch[first] ^ sketch[first + gap]) <= SKETCH)]
            if len(close):
                np.add.at(found, group[close], 1)
                left.append(close)
                right.append(close + gap)
                first = first[(found <= most)[group[first]]]
            gap += 1
        dense = (found > most)[group]
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            a, b = node[a[~dense[a]]], node[b[~dense[b]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["key", "a", "b"])
        if dense.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[dense]) for x in (key, node, root)], ["key", "a", "b"])

    def mixed(rows: np.ndarray) -> np.ndarray:
        """Without the keys whose rows all have one root: they connect nothing, however many they are."""
        heads = np.flatnonzero(np.diff(rows[0], prepend=-1))
        same = np.minimum.reduceat(rows[2], heads) == np.maximum.reduceat(rows[2], heads)
        return rows[:, ~np.repeat(same, np.diff(np.append(heads, rows.shape[1])))]

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        n += batch.num_rows
        if n >= FLUSH_ROWS:
            rows = np.concatenate(held, axis=1)
            end = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on in the next batch
            if end:
                yield from pairs(mixed(rows[:, :end]))
            held, n = [rows[:, end:]], n - end if end else 0
    if held and (rows := np.concatenate(held, axis=1)).size:
        yield from pairs(mixed(rows))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _dense(bits: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Edges that connect what all links of one group connect.

    Rows near a leader are its cluster and need no comparison with each other. Two clusters are
    compared member by member only as far as the triangle inequality leaves a link possible and
    they aren't connected yet.
    """
    a, b, clusters, radius = [], [], [], []
    rest = np.arange(len(bits))
    while len(rest):
        far = _distance(bits[rest], bits[rest[0]])
        near = far <= most
        clusters.append(rest[near])
        radius.append(int(far[near].max()))
        a += [int(rest[0])] * (int(near.sum()) - 1)
        b += rest[near][1:].tolist()
        rest = rest[~near]
    root = list(range(len(clusters)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    leaders, reach = bits[[c[0] for c in clusters]], np.array(radius)
    for k in range(len(clusters) - 1):
        possible = np.flatnonzero(_distance(leaders[k + 1 :], leaders[k]) <= most + reach[k] + reach[k + 1 :]) + k + 1
        for other in possible.tolist():
            if find(k) == find(other):
                continue
            for row in clusters[k].tolist():
                close = np.flatnonzero(_distance(bits[clusters[other]], bits[row]) <= most)
                if len(close):
                    a.append(row)
                    b.append(int(clusters[other][close[0]]))
                    root[find(other)] = find(k)
                    break
    return a, b


def _decided(group: np.ndarray, node: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within groups of rows, which stand together."""
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(heads, len(group)))
    left, right = [], []
    first = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for gap in range(1, SMALL):
        first = first[np.searchsorted(first, 0) : np.searchsorted(first, len(group) - gap)]
        first = first[group[first] == group[first + gap]]
        if not len(first):
            break
        close = first[_distance(bits[first], bits[first + gap]) <= most]
        left.append(node[close])
        right.append(node[close + gap])
    for k in np.flatnonzero(sizes > SMALL):
        rows = slice(heads[k], heads[k] + sizes[k])
        a, b = _dense(bits[rows], most)
        left.append(node[rows][a])
        right.append(node[rows][b])
    if not left:
        return node[:0], node[:0]
    return np.concatenate(left), np.concatenate(right)


def _links(most: int, forest: bool = False):
    """Edges (a, b) of what is near within groups: of different roots, or a ``forest`` that connects all of it."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(n: int) -> pa.RecordBatch:
            new = np.ones(n, dtype=np.int64)
            new[1:] = (ids[1:n, :3] != ids[: n - 1, :3]).any(axis=1)
            a, b = _decided(np.cumsum(new), np.arange(n), bits[:n], most)
            if forest:
                nodes, at = np.unique(ids[:n, 4], return_inverse=True)
                root = _roots(len(nodes), at[a], at[b])
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                return pa.RecordBatch.from_arrays([pa.array(nodes[root[moved]]), pa.array(nodes[moved])], ["a", "b"])
            differ = ids[a, 3] != ids[b, 3]
            a, b = ids[a[differ], 4], ids[b[differ], 4]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        ids, bits = np.zeros((0, 5), dtype=np.int64), np.zeros((0, WORDS64), dtype=_U64)
        for batch in batches:
            ids = np.concatenate([ids, np.stack([c.to_numpy() for c in batch.columns[:5]], axis=1).astype(np.int64)])
            bits = np.concatenate([bits, _bytes(batch.column(5)).view(_U64)])
            if len(ids) >= FLUSH_ROWS:
                others = np.flatnonzero((ids[:, :3] != ids[-1, :3]).any(axis=1))
                if len(others):  # the last group may go on in the next batch
                    n = int(others[-1]) + 1
                    yield flush(n)
                    ids, bits = ids[n:], bits[n:]
        if len(ids):
            yield flush(len(ids))

    return stream


def links(nodes: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK, first: int = 0) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp, root) with different roots: a forest of what is near in the early blocks from ``first`` on."""
    rows = map_arrow(nodes.select("node", "fp", "root"), _keys(first), "key long, node long, root long")
    return _grouped_links(rows, nodes, _links(most_bits(similarity)), chunk)


def _in_chunks(rows: DataFrame, name: str, more: list[str]) -> DataFrame:
    """``rows`` (``name``, node, parts): each one's chunk of its group, ``mine``, meets every other, as i and j."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(name, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), *more)


def _grouped_links(rows: DataFrame, nodes: DataFrame, function: Callable, chunk: int) -> DataFrame:
    """What ``function`` makes of the rows (key, node, root) of each key, in chunks, with their fingerprints.

    Keys under which all nodes have one root are left out: they connect nothing.
    """
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    shared = shared.select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    rows = _in_chunks(rows.join(shared, "key"), "key", ["node", "root"])
    rows = rows.join(nodes.select("node", "fp"), "node").select("key", "i", "j", "root", "node", "fp")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "root")
    return map_arrow(rows, function, "a long, b long")


def candidates(nodes: DataFrame, first: int = 0, end: int = KEYS) -> DataFrame:
    """(key, a, b): pairs of nodes (node, fp, root) with different roots that may have the similarity, with the key -1, and the rows (key, node, root) of dense keys.

    ``first`` and ``end`` tell the samples that are used.
    """
    rows = map_arrow(nodes.select("node", "fp", "root"), _sampled(first, end), "key long, node long, root long, sketch long")
    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), _met, "key long, a long, b long").distinct()


def _outside(nodes: DataFrame, similarity: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes`` (node, fp, root): (node, root, area), and the candidates (a, b) that aren't of one area.

    An area is what roots and the forests under dense keys connect, so two nodes that are near under such a key have one area.
    """
    areas, found = nodes.select("node", "root", F.col("root").alias("area")), None
    for first, end in ((0, AHEAD), (AHEAD, KEYS)):
        seen = nodes.select("node", "fp").join(areas.select("node", F.col("area").alias("root")), "node") if first else nodes
        met = gathered(candidates(seen, first, end), dealt=True)
        dense = met.where("key >= 0").select("key", F.col("a").alias("node"), F.col("b").alias("root"))
        forest = _grouped_links(dense, nodes, _links(max(AREA_BITS, farthest_bits(similarity)), forest=True), chunk)
        areas = gathered(_joined(areas, forest, "area", "area"))
        pairs = met.where("key < 0").select("a", "b")
        found = found.union(pairs) if first else pairs
    pairs = _near_pairs(found.distinct(), nodes, similarity)  # few are left
    for side in ("a", "b"):
        pairs = pairs.join(areas.select(F.col("node").alias(side), F.col("area").alias(f"area_{side}")), side)
    return areas, pairs.where("area_a != area_b").select("a", "b")


def _near_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose fingerprints the similarity can have."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("fp").alias(f"fp_{side}")), side)
    return map_arrow(pairs.select("a", "b", "fp_a", "fp_b"), _near(farthest_bits(similarity)), "a long, b long")


def _near(most: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distance(_bytes(batch.column(2)).view(_U64), _bytes(batch.column(3)).view(_U64))
            yield batch.filter(pa.array(far <= most)).select([0, 1])

    return near


def _sets(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in pieces(batch.column(1)):
                hashes, first = _shingles(raw, offsets, shingle)
                found = [hashes[first[k] : first[k + 1]].tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, type=pa.binary())], ["node", "s"])

    return sets


def _alike(similarity: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=_U64), np.frombuffer(y.as_buffer(), dtype=_U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield batch.filter(pa.array(keep)).select([0, 1])

    return alike


def _compared(similarity: float):
    """Edges (a, b) between rows (area, i, j, mine, node, root, s), which stand together by the first three: a forest of the links between different roots."""

    def decide(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        i, j, mine, node, root = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(1, 6))
        sets = [np.frombuffer(x.as_buffer(), dtype=_U64) for b in held for x in b.column(6)]
        sizes = np.array([len(x) for x in sets])
        kinds, shingles, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        there, again = np.zeros(len(kinds), dtype=bool), times[shingles] > 1
        shingles, shared = shingles[again], np.bincount(np.repeat(np.arange(len(node)), sizes)[again], minlength=len(node))
        starts = np.cumsum(shared) - shared
        top = np.unique(root, return_inverse=True)[1]
        # Two chunks are compared with each other, one with itself.
        rows, second = np.arange(len(node)), np.flatnonzero(mine == j[0])
        a, b = [], []
        for k in (rows if i[0] == j[0] else np.flatnonzero(mine == i[0])).tolist():
            others = rows[k + 1 :] if i[0] == j[0] else second
            others = others[top[others] != top[k]]
            # As many as a link needs have to be in other sets too.
            others = others[(np.minimum(shared[others], shared[k]) * (1 + similarity) >= similarity * (sizes[others] + sizes[k]) - 1e-6) & (shared[others] > 0)]
            if not len(others):
                continue
            n = shared[others]
            heads = np.cumsum(n) - n
            there[shingles[starts[k] : starts[k] + shared[k]]] = True
            both = np.add.reduceat(there[shingles[np.arange(n.sum()) + np.repeat(starts[others] - heads, n)]], heads, dtype=np.int64)
            there[shingles[starts[k] : starts[k] + shared[k]]] = False
            linked = others[both >= similarity * (sizes[k] + sizes[others] - both) - 1e-9]
            tops, at = np.unique(top[linked], return_index=True)
            a += [int(node[k])] * len(at)
            b += node[linked[at]].tolist()
            top[np.isin(top, tops)] = top[k]
        return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], ["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            ids = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[len(ids) > 0], (ids[1:] != ids[:-1]).any(axis=1)])[: len(ids)]).tolist()
            for first, end in zip(heads, [*heads[1:], len(ids)], strict=False):
                if held and tuple(ids[first]) != of:
                    yield decide(held)
                    held = []
                held.append(batch.slice(first, end - first))
                of = tuple(ids[first])
        if held:
            yield decide(held)

    return stream


def _sets_of(some: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the different shingles of those of ``texts`` (node, text) that ``some`` (node) has, and of few others."""
    return checkpointed(maybe_marked(texts, some, "node", _sets(shingle), "node long, s binary"))  # no text is shuffled here


def _alike_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("s").alias(f"s_{side}")), side)
    return gathered(map_arrow(pairs.select("a", "b", "s_a", "s_b"), _alike(similarity), "a long, b long"), dealt=True)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b), each there once, whose ``texts`` (node, text) have the similarity, by their sets of shingles."""
    pairs = gathered(pairs, dealt=True)
    return _alike_pairs(pairs, _sets_of(_ends(pairs), texts, shingle), similarity)


def _area_links(areas: DataFrame, sets: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """Pairs (a, b) at the similarity that connect, beside the roots, what all such pairs of nodes (node, root, area) of one area do."""
    rows = areas.join(sets.select("node", F.octet_length("s").alias("size")), "node")
    parts = F.ceil(F.greatest(F.count("*") / chunk, F.sum("size") / AREA_BYTES, F.lit(1))).cast("int")
    rows = rows.join(rows.groupBy("area").agg(parts.alias("parts")), "area").select("area", "node", "root", "parts")
    rows = _in_chunks(rows.join(sets, "node"), "area", ["mine", "node", "root", "s"])
    rows = rows.repartition("area", "i", "j").sortWithinPartitions("area", "i", "j")
    return gathered(map_arrow(rows, _compared(similarity), "a long, b long"), dealt=True)


def _joined(nodes: DataFrame, edges: DataFrame, name: str, of: str = "root") -> DataFrame:
    """``nodes`` (node, ``of``) with ``name``: the smallest ``of`` that each one's own reaches by ``edges`` of nodes."""
    for side in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node").alias(side), F.col(of).alias(f"r_{side}")), side)
    tops = components(edges.select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))).select(F.col("node").alias("_of"), F.col("root").alias("_top"))
    return nodes.join(tops, F.col(of) == F.col("_of"), "left").withColumn(name, F.coalesce("_top", of)).drop("_of", "_top")


def grouped(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """``nodes`` (node, fp) with top, the smallest node that each one's links reach.

    Forests of the early blocks join up dense groups, so that those aren't worked through pair by
    pair. Then every candidate with different roots is checked, whatever the forests left out.
    """
    named = nodes.withColumn("root", F.col("node"))
    for k in range(ROUNDS):
        early = verified(links(named, similarity, chunk, k * EARLY).distinct(), texts, shingle, similarity)
        named = gathered(_joined(named, early, "root"))
    areas, pairs = _outside(named, similarity, chunk)
    pairs = gathered(pairs, dealt=True)
    several = areas.groupBy("area").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("area")
    areas = gathered(areas.join(several, "area"), dealt=True)
    sets = _sets_of(_ends(pairs).union(areas.select("node")), texts, shingle)
    late = _alike_pairs(pairs, sets, similarity).union(_area_links(areas, sets, similarity, chunk))
    return _joined(named, late, "top").drop("root")


def representatives(documents: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """``documents``, all their columns, with one row of each group of near copies.

    The row with the smallest doc_id stays; null ids come last, equal ones go by a hash of the
    text. Rows are decided one by one, so of rows with one doc_id and different texts each may
    stay. Null and empty texts are copies of each other. Texts of fewer words than a shingle are a
    shingle of their own. Texts of any length count whole. An empty table gives an empty result.
    Columns may have any names. Texts are written once, with row numbers, and shuffled once, by
    the row's number, without a sort.
    """
    fp, row = free_name(documents, "fp"), free_name(documents, "row")
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    schema = StructType([*numbered.schema.fields, StructField(fp, BinaryType())])
    rows = checkpointed(map_arrow(numbered, _with_fingerprints(documents.columns.index("text"), shingle, fp), schema))
    best = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col(row).alias("row"))
    nodes = checkpointed(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(row).alias("node"), F.min(best).alias("best")))
    groups = grouped(nodes, rows.select(F.col(row).alias("node"), "text"), shingle, similarity, chunk).groupBy("top").agg(F.min("best").alias("best"))
    keep = groups.select(F.col("best.row").alias(row))
    return rows.join(keep.hint("shuffle_hash"), row, "left_semi").select(*[f"`{c}`" for c in documents.columns])
