"""Vectorised hashing of texts as bytes: word and window hashes from prefix sums of a polynomial, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TABLE2 = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z only
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """BASE ** (sign * i) for i < n, modulo 2 ** 64."""
    if len(_powers[sign]) < n:
        step = np.full(max(n, 1 << 21), BASE if sign > 0 else INVERSE, np.uint64)
        step[0] = 1
        _powers[sign] = np.multiply.accumulate(step)
    return _powers[sign][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """P with P[i] = sum of table[data[j]] * BASE**j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data)), out=out[1:])
    return out


def windows(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal strings wherever they stand."""
    return (p[end] - p[start]) * powers(len(p), -1)[start]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls and the offsets of its rows."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]] if len(at) else np.zeros(0, np.uint8), at - at[0]


def blocks(column: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last + 1, their bytes, their offsets) of about `size` bytes; one longer row stands alone."""
    data, at = column_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True that stays within one row."""
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(mask))]
    begins[edge] = mask[edge]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    ends[edge - 1] = mask[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1
