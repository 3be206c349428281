"""Vectorised words and hashes over the bytes of an Arrow string column.

A word is a maximal run of bytes outside `[\\x20\\x09-\\x0D]`; A-Z count as a-z. All functions work on whole
batches at once, so their cost is a few NumPy passes over the bytes and not a Python call a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
MARKS = SPACE.copy()  # white space, control characters and ASCII punctuation
MARKS[[i for i in range(128) if not chr(i).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
PIECE = 1 << 20  # bytes hashed at a time; a longer single word is taken whole

_tables: dict[str, np.ndarray] = {}


def release() -> None:
    """Give freed memory back to the system: Python workers stay for later tasks, and several of them share an executor."""
    import ctypes
    import gc

    _tables.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call, and needs none
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n reproducible pseudo-random 64-bit values."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + np.uint64((seed * 0xD1342543DE82EF95 + 1) % 2**64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for the next call."""
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("pow", BASE), ("inv", pow(BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["pow"], _tables["inv"]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the offsets of the rows (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run `values[start:end]`; `values` are per-symbol random numbers, not yet weighted.

    A polynomial hash from prefix sums: the difference of two sums, moved back to power 0.
    """
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, "right")))
        low, high = int(starts[k]), int(ends[last - 1])
        power, inverse = powers(high - low)
        weighted = values(low, high) * power[:high - low]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(weighted, out=sums[1:])
        s, e = starts[k:last] - low, ends[k:last] - low
        out[k:last] = (sums[e] - sums[s]) * inverse[s]
        k = last
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_runs(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside `breaks`, which never cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~space
    start[1:] &= space[:-1] | edge[1:n]
    stop = ~space
    stop[:-1] &= space[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def word_hashes(column: pa.Array, seed: int = 0, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of the rows in them."""
    data, offsets = column_bytes(column)
    starts, ends = word_runs(data, offsets, breaks)
    symbol = seeded(256, seed)[LOWER]
    hashes = run_hashes(lambda a, b: symbol[data[a:b]], starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int, weights: np.ndarray) -> np.ndarray:
    """A hash of each run of `size` words. Runs that cross rows are the caller's to leave out."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out += words[i:len(words) - size + 1 + i] * weights[i]
    return mix(out)
