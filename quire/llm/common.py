"""Shared parts of the training-data operators: tables, checkpoints and byte-level text kernels.

The kernels read Arrow string buffers directly as ``uint8`` arrays. A batch is cut into
pieces of a bounded number of bytes (a single longer text makes a piece of its own), so the
memory of a Python worker follows ``PIECE_BYTES`` and the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import checkpointed, map_arrow  # noqa: F401

#: Bytes of text that the kernels handle at once.
PIECE_BYTES = 1 << 20
#: Bits of the map of ids that keeps other texts out of a shuffle; 8 MB at any size of the corpus.
MAP_BITS = 1 << 26

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: ASCII lower-casing of A-Z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z, non-ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes of letters, as far as bytes tell: a-z and non-ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True
#: Bytes of ``[^\x20\x09-\x0D]``.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[9:14] = NONSPACE[32] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, … that no column has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if n not in taken)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets), each of about ``limit`` bytes."""
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, where no run crosses a text's end."""
    if not len(member):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before = np.empty_like(member)
    before[0] = False
    before[1:] = member[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(member)]] = False
    after = np.empty_like(member)
    after[-1] = False
    after[:-1] = member[1:]
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", inverse)):
                    x = np.full(size, base, dtype=_U64)
                    x[0] = 1
                    setattr(self, name, np.cumprod(x, dtype=_U64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U64(32))
        x = x * _U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> _U64(29))
        x = x * _U64(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of ``values[start:end]``; they don't depend on the place.

    Long arrays are hashed block by block, so that the sums take no more memory than a block's.
    """
    if len(values) <= PIECE_BYTES or not len(starts):
        return _span_hashes(values, starts, ends)
    order = None
    if (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    out = np.empty(len(starts), dtype=_U64)
    k = 0
    while k < len(starts):
        base = starts[k]
        n = int(np.searchsorted(starts, base + PIECE_BYTES))
        out[k:n] = _span_hashes(values[base : ends[k:n].max()], starts[k:n] - base, ends[k:n] - base)
        k = n
    if order is None:
        return out
    back = np.empty_like(out)
    back[order] = out
    return back


def _span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=_U64)
        np.cumsum((values.astype(_U64) + _U64(1)) * up[1:], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U64))


def blocks(member: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a long array behind about ``size`` items each, at places that aren't ``member``, so that no run is cut."""
    at = 0
    while at < len(member):
        end = min(len(member), at + size)
        while end < len(member) and member[end]:
            rest = np.flatnonzero(~member[end : end + size])
            end = end + int(rest[0]) if len(rest) else min(len(member), end + size)
        yield at, end
        at = end


def row_counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of runs in each text, and by their cumulated sums the first run of each."""
    return np.searchsorted(starts, offsets).astype(np.int64)


def bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _kept(shared, then=None):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            yield batch.filter(pa.array((shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool))).select([0, 1])

    return (lambda batches: then(keep(batches))) if then else keep


def maybe_marked(documents: DataFrame, marks: DataFrame, of: str, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """``of``, an id, and text of all documents whose ids ``marks`` has, and of few others, without a shuffle.

    The ids' hashes are set in a map of fixed size. The more ids there are, the more others pass;
    a join has to follow where those matter. ``then``, a function for ``map_arrow`` that gives
    ``schema``, gets the rows in the same Python worker: a second one for each task costs its memory.
    """
    bit = F.pmod(F.xxhash64(of), F.lit(MAP_BITS))
    one = F.expr("shiftleft(1L, cast(b & 31 as int))")
    got = marks.select(bit.alias("b")).select(F.shiftright("b", 5).alias("w"), one.alias("one")).groupBy("w").agg(F.bit_or("one").alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS >> 5, dtype=np.uint32)
    bits[got.column("w").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    shared = documents.sparkSession.sparkContext.broadcast(bits)
    return map_arrow(documents.select(of, "text", bit.alias("bit")), _kept(shared, then), schema or documents.select(of, "text").schema)
