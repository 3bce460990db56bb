"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.runtime import stage

# A word is a run of characters other than these; written as character class contents for Java and Python.
WHITE = r"\x20\x09-\x0D"
WHITE_CHARS = " \t\n\x0b\x0c\r"
# Sides of a join are broadcast only after their rows were counted and found below this many bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WHITE}]+"))


def hold(df: DataFrame, *columns: Column) -> DataFrame:
    """Add computed columns behind a one-row generator.

    Catalyst never moves an expression through a generator, so an array that later lambdas refer to
    many times is computed once per row and not once per reference.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a written frame for broadcast if its counted rows take at most BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def text_key(text: str = "text") -> Column:
    """64 bits of a text, null-safe; with the id it tells rows apart whose ids repeat."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\x00null")))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lengths = np.diff(offsets)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    if column.null_count:
        empty = ~np.asarray(column.is_valid())
        if lengths[empty].any():
            data = data[np.repeat(~empty, lengths)]
            lengths = np.where(empty, 0, lengths)
    return data, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        values = batch.column(column)
        if batch.num_rows == 0:
            continue
        _, offsets = byte_rows(values)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (n + 1 numbers)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    at_row = offsets[:-1][offsets[:-1] < n]
    row_start = np.zeros(n + 1, bool)
    row_start[at_row] = True
    starts = np.flatnonzero(inside & (~before | row_start))
    row_end = np.zeros(n + 1, bool)
    row_end[offsets[1:]] = True
    ends = np.flatnonzero(before & (~inside | row_end))
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse, modulo 2^64; kept for the next call."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 17)
        both = []
        for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes; words come in order."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + (1 << 16), side="right")))  # a block that fits the cache
        s, e = starts[a:b] - lo, ends[a:b] - lo
        n = int(e[-1])
        powers, back = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo : lo + n].astype(np.uint64) + np.uint64(1)) * powers[:n], out=total[1:])
        out[a:b] = (total[e] - total[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        a = b
    return mix(out)


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back; null-typed columns are not expected here."""
    return stage(df)
