"""Array work shared by the text operators: batches, rolling hashes, word bounds.

Hashes are 64-bit polynomials (arithmetic wraps) over a random table of symbols,
finished with a splitmix step; equal strings always get equal hashes.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that an array kernel takes at once; one longer text goes alone.
SLICE_BYTES = 1 << 20


def trim() -> None:
    """Hand unused memory back: a reused worker keeps its share of the executor small between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable) -> Callable:
    """`run` over Arrow batches, memory trimmed when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finisher."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(BASE))


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n."""
    if len(_powers[0]) <= n:
        for at, b in enumerate((BASE, BASE_INVERSE)):
            x = np.full(max(n + 1, SLICE_BYTES + 4096), b, U64)
            x[0] = 1
            _powers[at] = np.multiply.accumulate(x)
    up, down = _powers
    if len(up) > 4 * SLICE_BYTES:  # one giant text must not pin its tables
        _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    return up, down


class RollingHash:
    """Hashes of any substring of a symbol array in O(1)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        """Hash of values[i : i + size] for every i; no finisher."""
        m = len(self.sums) - size
        return (self.sums[size:] - self.sums[:m]) * self.down[:m] if m > 0 else np.zeros(0, U64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold about `limit` bytes; a longer text goes alone."""
    at = batch.schema.get_field_index(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row (null: empty), and len + 1 offsets into them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - (off[0] if len(off) else 0)


def space_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each text the number of words before it."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = solid[inner]  # words end with their text
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + counts[i] - 1 for every i, one after another."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)
