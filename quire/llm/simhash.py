"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

1. Texts become 64-bit fingerprints (Python over Arrow, one text at a time).
2. Equal fingerprints are one node; everything below works on distinct fingerprints.
3. A fingerprint is cut into ``BLOCKS`` blocks. Two that differ in at most ``DISTANCE`` bits
   agree in at least ``BLOCKS - DISTANCE`` blocks, so they share one of the keys made of that
   many blocks. A key with many fingerprints is cut into chunks of about ``CHUNK`` by a hash,
   and each pair of chunks is a group of its own: groups are bounded, and no pair is left out.
4. Rows sorted by group stream through numpy, which compares all pairs of a group exactly and
   gives back a spanning forest of the links, not the pairs: at most one edge a fingerprint.
5. Large-star and small-star rounds join the forests into components, with a checkpoint each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bytes_of, checkpointed
from quire.runtime import gathered, map_arrow

SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7
CHUNK = 1024
#: Bytes of a text that are read at once.
TEXT_BLOCK = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Rows that a task gathers before it looks for links; whole groups only, so it may be more by one group.
FLUSH_ROWS = 100_000


def _word_blocks(text: bytes, size: int = TEXT_BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, block by block."""
    if len(text) <= size:
        yield text.lower().split()
        return
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = _BLANK.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The contract's fingerprint of a text, as an unsigned number. Long texts are read block by block."""
    digest, ones, n, held = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0, []

    def add(words: list[bytes], size: int) -> None:
        nonlocal n, ones
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts, ends = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1], ends[size - 1 :]
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)

    for words in _word_blocks(text or b""):
        words = held + words
        if len(words) >= shingle:
            add(words, shingle)
            held = words[len(words) - shingle + 1 :]
        else:
            held = words
    if not n and held:
        add(held, len(held))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter(map(fingerprint, bytes_of(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long. Null and empty texts have 0."""
    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), _fingerprints, "doc_id long, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """For each choice of ``blocks - distance`` blocks, the mask of their bits, as a signed long."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 under edges (a, b), the smallest node of each one's component."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _forest(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smaller, larger) that connect what links within groups connect; rows are sorted by group."""
    nodes, at = np.unique(fp, return_inverse=True)
    bits = nodes.view(np.uint64)[at]
    left, right = [], []
    first = np.arange(len(fp))  # rows that still have a row of their group ``gap`` behind them
    gap = 1
    while True:
        first = first[: np.searchsorted(first, len(fp) - gap)]
        first = first[group[first] == group[first + gap]]
        if not len(first):
            break
        close = first[np.bitwise_count(bits[first] ^ bits[first + gap]) <= distance]
        left.append(at[close])
        right.append(at[close + gap])
        gap += 1
        if gap % 64 == 0:  # keep what a large group of close fingerprints has gathered small
            root = _roots(len(nodes), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            left, right = [root[moved]], [moved]
    if not left:
        return nodes[:0], nodes[:0]
    root = _roots(len(nodes), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def _links(distance: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
            a, b = _forest(np.cumsum(new), rows[:, 4].copy(), distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = np.zeros((0, 5), dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int64)])
            if len(held) >= FLUSH_ROWS:
                others = np.flatnonzero((held[:, :4] != held[-1, :4]).any(axis=1))
                if len(others):  # the last group may go on in the next batch
                    yield flush(held[: others[-1] + 1])
                    held = held[others[-1] + 1 :]
        if len(held):
            yield flush(held)

    return stream


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    keys = F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(_masks(blocks, distance))])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("k.c", "k.v", "fp")
    shared = rows.groupBy("c", "v").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.join(shared.select("c", "v", "parts"), ["c", "v"]).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("c", "v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    rows = rows.repartition("c", "v", "i", "j").sortWithinPartitions("c", "v", "i", "j")
    return map_arrow(rows, _links(distance), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): the smallest node that each one reaches.

    Large-star and small-star rounds until nothing changes. Every aggregate combines before its
    shuffle, and a hub's many edges are a skewed join that Spark splits.
    """
    edges = gathered(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = None
    while True:  # a round at least halves the longest chain, so there are few
        # Large star: of all neighbours, the larger ones go to the smallest.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m"), F.col("b"))).where("x < y")
        edges = gathered(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, fp, component_id (the smallest doc_id that its fingerprint's links reach).

    Null and empty texts have fingerprint 0 and link like others. Repeated doc_ids are rows like
    others; a null doc_id is never the smallest, and a component of none but those has a null
    component_id. An empty table gives an empty result; other columns are ignored.
    """
    rows = checkpointed(fingerprints(documents))  # texts are read once
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), distance, blocks, chunk))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "least", "root")
    # The root's own least doc_id counts too; a root is not a node of ``roots``.
    hubs = nodes.join(roots.select("root").distinct(), F.col("fp") == F.col("root")).select("fp", "least", "root")
    members = linked.union(hubs)
    best = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(best, "root").select(F.col("fp").alias("_fp"), "component_id")
    nodes = nodes.join(named, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    nodes = checkpointed(nodes)  # so that the join of a fingerprint with very many copies is split
    return rows.join(nodes, "fp").select("doc_id", "fp", "component_id")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash_near_dedup(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")

