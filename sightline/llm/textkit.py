"""Vectorised text helpers for Arrow tasks: words, word hashes and window hashes.

Everything works on slices of an Arrow string column, about a megabyte at a time, so a
task's memory does not depend on the size of a batch. Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (xor-shift-multiply)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Slice:
    """Rows [first, last) of a batch: their bytes, and where each row's text begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive rows of a string column, of about ``limit`` bytes (one row at least)."""
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.type == pa.large_string()
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a slice: byte ranges, 64-bit hashes, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of_row: np.ndarray


def words(part: Slice, lower: bool = False) -> Words:
    """Runs of bytes other than space and U+0009 to U+000D; A-Z become a-z if ``lower``."""
    data = LOWER[part.data] if lower else part.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(U), np.zeros(len(part.offsets), np.int64))
    inside = IS_WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    rows = part.offsets[:-1]
    before[rows[rows < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = part.offsets[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    of_row = np.searchsorted(start, part.offsets)
    return Words(start, end, run_hash(BYTE_VALUES[data], start, end), of_row)


def run_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of each run values[start:end], mixed with its length."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` consecutive hashes."""
    start = np.arange(max(0, len(hashes) - width + 1))
    return run_hash(hashes, start, start + width)


def sliding(f, values: np.ndarray, width: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over every run of ``width`` values, in log(width) steps."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have = 1
    while have * 2 <= width:
        values = f(values[:-have], values[have:])
        have *= 2
    return f(values[:n], values[width - have : width - have + n])


def shingles(row: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a row's word windows; a shorter row is one window."""
    if not len(row):
        return row
    return np.unique(window_hash(row, min(width, len(row))))
