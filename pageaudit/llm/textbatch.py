"""Whole texts as byte arrays: words, lines and 64-bit hashes of an Arrow batch in a few numpy steps.

All functions work on slices of a few megabytes, so that memory is bounded by the slice
(and by the longest single text), never by the partition.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: U+0020 and U+0009 to U+000D separate words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: A random odd word for each byte value; a span hashes to the sum of TABLE[byte] * BASE^position.
TABLE = np.random.default_rng(20240229).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE^0 ... BASE^(n-1), kept between calls up to a million."""
    global _powers
    if len(_powers) >= n:
        return _powers[:n]
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    out = np.cumprod(out)
    if n <= 1 << 20:
        _powers = out
    return out


def release() -> None:
    """Gives memory that is not in use back to the system, so that a worker's next task starts small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches, column: str, max_bytes: int = SLICE_BYTES):
    """The batches cut into pieces of about ``max_bytes`` of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        release()  # what the batch took goes back before the next comes


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of(kept: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of kept bytes within each row, and the first run of each row (with the total last)."""
    if not len(kept):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(kept) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(kept), bool)
    before[0], before[1:] = True, ~kept[:-1]
    starts = np.flatnonzero(kept & (before | edge[:-1]))
    after = np.empty(len(kept), bool)
    after[-1], after[:-1] = True, ~kept[1:]
    ends = np.flatnonzero(kept & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the ascending, disjoint, non-empty spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = TABLE[data[at + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[at]
    return mix(np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each span, from the first span of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a row, and the position of the first word of each."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:size].copy()
    for j in range(1, n):
        out = out * BASE + hashes[j : j + size]
    left = np.repeat(first[1:], np.diff(first))[:size]
    at = np.flatnonzero(np.arange(size) + n <= left)
    return mix(out[at]), at


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marked positions lie in each row."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges ``values[start : start + size]``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)]
