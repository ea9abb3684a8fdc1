"""Exact top-k search by block-at-a-time pruning.

Candidates lie in ranges of ids, packed into groups of ``RANGE`` rows and these cut into blocks of
``BLOCK``. A block has a forward index (its integer vectors and ids) and, per dimension, the largest
and smallest component. For a query the sum over dimensions of the larger of ``q * largest`` and
``q * smallest`` bounds all scores of the block. Queries score blocks in the order of falling
bounds, through the forward index, until the bound falls below their k-th score.

Queries are a stated set, packed into blocks of ``QUERY_BLOCK`` rows by the executors. Every block
of queries meets every group of candidates, a row of each at a time; nothing goes through the
driver, and of each such pair only k rows per query are shuffled. Vectors of different lengths
are packed by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpointed
from quire.runtime import map_arrow

K = 5
EVERY = 50
SCALE = 256
BLOCK = 1024
QUERY_BLOCK = 4096
#: Rows of a packed group of candidates at most.
RANGE = 16 * BLOCK
#: Sums of products below this are exact in doubles.
_EXACT = float(1 << 53)
_LARGEST = np.finfo(np.float64).max


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors have no null and only finite components, as floor(SCALE * x) in doubles."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        flat = vectors.values
        offsets = vectors.offsets.to_numpy().astype(np.int64)
        good_values = np.ones(len(flat), dtype=bool) if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
        good_values &= np.isfinite(values)
        bad = np.concatenate(([0], np.cumsum(~good_values)))
        keep = (bad[offsets[1:]] == bad[offsets[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        # Products of a component whose multiple leaves the doubles are beyond 64 bits anyway.
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(SCALE * np.where(good_values, values, 0.0)), -_LARGEST, _LARGEST)
        out = [whole[offsets[k] : offsets[k + 1]].tobytes() for k in np.flatnonzero(keep)]
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), pa.array(out, type=pa.binary())], ["vec_id", "v"])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer rows of a and b, exactly."""
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.filled = np.zeros((n, k), dtype=bool)

    def least(self) -> np.ndarray:
        """What a score must reach to come among the best."""
        return np.where(self.filled[:, -1], self.scores[:, -1].astype(np.float64), -np.inf)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        k = self.scores.shape[1]
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        f = np.concatenate([self.filled[rows], allowed], axis=1)
        s = np.where(f, s, np.iinfo(np.int64).min)
        i = np.where(f, i, np.iinfo(np.int64).max)
        by = np.lexsort((i, -s.astype(np.float64) if np.abs(s[f]).max(initial=0) < _EXACT else ~s, ~f), axis=1)[:, :k]
        self.scores[rows], self.ids[rows], self.filled[rows] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1), np.take_along_axis(f, by, 1)


def _search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: _Best, block: int) -> None:
    """Score the blocks of a range of candidates, best bounds first, until bounds fall below the k-th scores."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    cuts = range(0, len(ids), block)
    largest = np.stack([vectors[a : a + block].max(axis=0) for a in cuts])
    smallest = np.stack([vectors[a : a + block].min(axis=0) for a in cuts])
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.maximum(queries, 0) @ largest.T + np.minimum(queries, 0) @ smallest.T
        bounds = bounds + np.abs(bounds) * 1e-9  # rounding of very large sums
    bounds[np.isnan(bounds)] = np.inf
    turns = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(len(queries))
    for turn in range(len(cuts)):
        at = turns[active, turn]
        going = bounds[active, at] >= best.least()[active]
        active, at = active[going], at[going]
        if not len(active):
            return
        for b in np.unique(at):
            rows = active[at == b]
            some = slice(b * block, (b + 1) * block)
            allowed = ids[some][None, :] != query_ids[rows][:, None]
            best.add(rows, _products(queries[rows], vectors[some]), ids[some], allowed)


def _packed(rows: int):
    """(d, ids, vectors) of (vec_id, v): groups of at most ``rows`` vectors of one length, as they come."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[bytes]]] = {}

        def out(d: int) -> pa.RecordBatch:
            ids, vectors = held.pop(d)
            return pa.RecordBatch.from_arrays([pa.array([d], type=pa.int32()), pa.array([np.concatenate(ids).tobytes()], type=pa.binary()), pa.array([b"".join(vectors)], type=pa.binary())], ["d", "ids", "vectors"])

        for batch in batches:
            ids, size = batch.column(0).to_numpy(), np.diff(_offsets(batch.column(1))) // 8
            vectors = batch.column(1).to_pylist()
            for d in np.unique(size[size > 0]).tolist():
                some = np.flatnonzero(size == d)
                while len(some):
                    own = held.setdefault(d, ([], []))
                    now = some[: rows - len(own[1])]
                    own[0].append(ids[now])
                    own[1].extend(vectors[k] for k in now)
                    some = some[len(now) :]
                    if len(own[1]) >= rows:
                        yield out(d)
        for d in list(held):
            yield out(d)

    return pack


def _found(k: int, block: int):
    """The k best of each pair of a group of candidates and a block of queries."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                d, ids, vectors, dq, query_ids, queries = (c[row].as_py() for c in batch.columns)
                if d != dq:
                    continue
                query_ids, queries = np.frombuffer(query_ids, dtype=np.int64), np.frombuffer(queries, dtype=np.float64).reshape(-1, d)
                best = _Best(len(queries), k)
                _search(queries, query_ids, np.frombuffer(vectors, dtype=np.float64).reshape(-1, d), np.frombuffer(ids, dtype=np.int64), best, block)
                rows, places = np.nonzero(best.filled)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]), pa.array(best.ids[rows, places]), pa.array(best.scores[rows, places])], ["query_id", "vec_id", "score"])

    return find


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind, count=column.offset + len(column) + 1)[column.offset :]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK, range_rows: int = RANGE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but
    those with the query's own vec_id. Rows whose id or vector is null, or whose vector holds a
    null or non-finite component, take no part. Vectors of different lengths have no product and
    don't meet. Repeated rows are candidates each; a query whose id occurs with several vectors
    is asked with the one that comes first in the order of its components. Scores beyond 64 bits
    are cut off there, and so are multiples of components beyond the doubles. No queries or
    candidates give an empty result; other columns are ignored, whatever their names.
    """
    rows = map_arrow(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), _quantised, "vec_id long, v binary")
    rows = checkpointed(rows.repartitionByRange("vec_id"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    schema = "d int, ids binary, vectors binary"
    candidates = checkpointed(map_arrow(rows, _packed(range_rows), schema))
    queries = checkpointed(map_arrow(asked, _packed(query_block), schema)).select(F.col("d").alias("dq"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    found = map_arrow(candidates.crossJoin(queries), _found(k, block), "query_id long, vec_id long, score long")  # a stated query set against all rows, in blocks
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_top_k(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
