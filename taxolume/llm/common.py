"""The held-out fold, bounded samples and byte-level text kernels that the operators use."""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that nothing may be learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: str, text: str, rows: int, most_bytes: int) -> DataFrame:
    """Rows of df, at most `rows` with at most `most_bytes` bytes of text in all, chosen by a hash of key and other
    columns; rows that agree in all columns count once. All of df, but for such repeats, if it is that small."""
    own = F.xxhash64(F.col(key), F.lit(17), *[F.col(c) for c in df.columns if c != key])
    hashed = df.withColumn("_h", own)
    sizes = hashed.select("_h", F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
    low, n = -(1 << 63), sizes.count()
    below = low + int((1 << 64) * min(1.0, 2 * rows / max(1, n))) - 1  # twice as many as needed, so that sorting is small
    first = sizes.filter(F.col("_h") <= below).groupBy("_h").agg(F.max("n").alias("n")).orderBy("_h").limit(rows).collect()
    held, last = 0, low
    for r in first:
        held += r["n"]
        if held > most_bytes:
            break
        last = r["_h"]
    return hashed.filter(F.col("_h") <= last).dropDuplicates(["_h"]).drop("_h")


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker does, across tasks."""
    return sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")).__dict__.setdefault("held", {})


def release() -> None:
    """Gives memory that this worker no longer uses back to the system; workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run):
    """run, a function of batches, with its memory released at the end of each task."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def utf8_slices(column: pa.Array, most: int = 1 << 20):
    """(first row, bytes, offsets) for runs of rows with about `most` bytes at most; a null is an empty text.

    A longer text gets a run of its own, so memory follows the longest text and not the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D, and the number of them in each text."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # a word ends where its text does
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_BASE = 0x9E3779B97F4A7C55


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = worker_cache()
    if len(held.get("powers", ())) < n:
        size = max(n, 1 << 20) + 1
        for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            held[name] = np.multiply.accumulate(p)
    return held["powers"][:n], held["inverse"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the spans, the same for equal bytes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data))
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers, out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
