"""Shared pieces: Arrow text buffers as numpy arrays, words, hashes, checkpoints.

Operators see their text through ``chunks``: whole documents, null as empty, in slices of a few megabytes, so
a worker's memory is set by the slice (or by the longest single text), never by the partition. Media and packing take
rows of an Arrow batch by fixed numbers instead.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import forget, saved  # noqa: F401

CHUNK_BYTES = 2 << 20
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_IP = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_array(column) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets, from 0."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    lo, hi = int(off[0]), int(off[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return raw, off - lo


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """(slice of the batch, texts, bytes, offsets) for runs of whole documents."""
    for batch in batches:
        texts = text_array(batch.column(text))
        _, off = flat(texts)
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            part = texts.slice(i, j - i)
            yield batch.slice(i, j - i), part, *flat(part)
            i = j


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int, base: int = _P) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values)), out=total[1:])
    return total


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of values[start:end] for each range: a polynomial by prefix sums."""
    if total is None:
        total = prefix_sums(values)
    h = (total[ends] - total[starts]) * powers(len(total), _IP)[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the
    index of its first word (n + 1 of them)."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = solid[edge]
    edge = off[1:][off[:-1] < off[1:]] - 1
    last[edge] = solid[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(data, off):
    """(hash of each word, first word of each text, starts, ends)."""
    starts, ends, first = words(data, off)
    return ranges_hash(data, starts, ends), first, starts, ends


def released() -> None:
    """Gives what a worker has freed back to the system, as the worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def sha(data) -> str:
    return hashlib.sha256(data).hexdigest()


def span_columns(found: list[tuple[int, int, int]], names) -> str:
    """``kind:start:end`` of (start, kind, end), by start, then kind."""
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found))
