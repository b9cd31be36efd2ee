"""Shared helpers: whole texts as flat byte arrays, hashing and the held-out fold."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that the numpy code handles at a time; a longer text is one piece of its own.
PIECE_BYTES = 4 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def small_batches(df: DataFrame, megabytes: int = 16) -> DataFrame:
    """Bound what one Arrow batch holds, so that a worker's memory does not follow the longest texts.

    The bound is a setting of the session and stays for later queries: only a larger one is lowered, and no result hangs
    on it.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)):
        now = df.sparkSession.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            df.sparkSession.conf.set(key, str(most))
    return df


def tidied(function):
    """A map over batches that gives the memory it has freed back when its partition ends: workers live on for other
    stages, and what the allocators keep would add up."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, nulls as empty, and the n + 1 offsets of its rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return flat, at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, rows)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def words(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space in a byte array."""
    ink = np.empty(len(flat) + 2, dtype=bool)
    ink[0] = ink[-1] = False
    ink[1:-1] = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    return edge[::2], edge[1::2]


def run_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run; equal bytes hash alike wherever they stand. Runs must not overlap or be empty."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    inside = np.arange(int(lengths.sum())) + np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    place = (inside - np.repeat(starts, lengths)).astype(np.uint64)
    weighed = (flat[inside].astype(np.uint64) + np.uint64(1)) * mix((place + np.uint64(1)) * ODD)
    return mix(np.add.reduceat(weighed, np.cumsum(lengths) - lengths) ^ (lengths.astype(np.uint64) * ODD))


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
