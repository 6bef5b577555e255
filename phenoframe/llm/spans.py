"""Byte spans of Arrow text columns in NumPy: words, 64-bit span hashes and block-wise traversal.

Every function works on the UTF-8 bytes of many documents at once and never lets a span cross a
document. Nulls are empty texts. Memory is bounded by the block size or, if larger, one text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _trim = None


def release() -> None:
    """Hand free memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task function ``run``, which releases memory when it ends."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def byte_class(excluded) -> np.ndarray:
    """Lookup table that is true for every byte outside ``excluded``."""
    table = np.ones(256, dtype=bool)
    table[list(excluded)] = False
    return table


NOT_SPACE = byte_class([0x20, *range(0x09, 0x0E)])
ALPHANUMERIC = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offset at which each row starts (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset: column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def blocks(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, side="right")) - 1)
        yield row, end
        row = end


def spans(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes for which ``inside`` holds."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | cut[1:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | cut[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, side="right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        both = []
        for base in (_BASE, _BASE_INVERSE):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        if n > 4 * BLOCK_BYTES:
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(value: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(27)
    value *= np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; equal bytes give equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    term = raw.astype(np.uint64)
    term += np.uint64(1)
    term *= up[: len(raw)]
    np.cumsum(term, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position of ``first``; all must lie inside the array."""
    value = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        value = value * np.uint64(0xD6E8FEB86659FD93) + words[first + k]
    return mix(value + np.uint64(size))


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive pieces of ``values``."""
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
