"""Vectorised handling of text columns: bytes and offsets, words, 64-bit hashes.

All of it works on the UTF-8 bytes of an Arrow column without a Python object for each word.
A null text counts as an empty one. Words are runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = (np.ones(1, U), np.ones(1, U))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its texts in them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `most` bytes in all; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts at `offsets` of `data`, and the number of words before each offset."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(space[data], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] |= inside[1:-1][edges]
    edges = edges[edges > 0] - 1
    last[edges] |= inside[1:-1][edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's multiplier and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _MULTIPLIER, U), np.full(n, pow(_MULTIPLIER, -1, 2**64), U)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """Hashes of any spans of some bytes, from sums over prefixes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLE[data] * self.up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Empty spans hash to the same value. Spans of equal bytes hash equally wherever they stand."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes and so on; of ordered values the high ones compress to little."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplaned(data: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
