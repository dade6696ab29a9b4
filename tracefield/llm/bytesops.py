"""Vectorised operations on the UTF-8 buffers of Arrow string columns.

Texts are handled in slices of a few megabytes (one longer text makes a slice
of its own), so that a task's memory follows the slice and not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a slice.
SLICE = 1 << 20
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all others (a splitmix step)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` well-spread 64-bit constants for a seed."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(BASE))


_SYMBOL = stream(256, 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, SLICE + (SLICE >> 2))
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(n, b, dtype=_U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    out = _powers[0], _powers[1]
    if n > 4 * SLICE:  # tables for one very long text are not kept
        _powers[0], _powers[1] = out[0][: 2 * SLICE].copy(), out[1][: 2 * SLICE].copy()
    return out


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = pc.fill_null(col, b"" if binary else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of ``col`` of at most ``limit`` bytes each, or one row."""
    lengths = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    at = used = 0
    for i, n in enumerate(lengths):
        if i > at and used + n > limit:
            yield at, i
            at, used = i, 0
        used += int(n)
    if at < len(lengths):
        yield at, len(lengths)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the number of the first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    before |= edge[:-1]
    starts = np.flatnonzero(inside & before)
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    after |= edge[1:]
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``values`` (64 bits each); equal runs have equal hashes wherever they stand."""
    power, inverse = _power(len(values) + 1)
    total = np.empty(len(values) + 1, dtype=_U)
    total[0] = 0
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return run_hashes(_SYMBOL[data], starts, ends)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` successive values (len(h) - n + 1 of them, none if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = h[:m].copy()
    for k in range(1, n):
        out *= _U(BASE)
        out += h[k : k + m]
    return mix(out + _U(n))


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the n + 1 values that say where rows begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def trim() -> None:
    """Give memory that is free back to the system: a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())
