"""Splitting texts into BPE words, vectorised for common code points.

``split`` follows the published patterns of the two tokenizers for code points whose class is
stable (Latin letters, ASCII, usual punctuation). Rows with any other code point, or with the
spelling of a special token, are left to the tokenizers library by the callers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from .textkit import BYTE_VALUES, Slice, run_hash

OTHER, LETTER, NUMBER, SPACE, UNSAFE = range(5)
TABLE_SIZE = 0x2060

# What the patterns name after an apostrophe.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def _class_of(code: int) -> int:
    if code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        return SPACE
    if 0x1C <= code <= 0x1F or code in (0x85, 0xA0, 0x130) or 0x250 <= code < 0x2010 or 0x2028 <= code <= 0x202F or code >= 0x205F:
        return UNSAFE
    kind = unicodedata.category(chr(code))[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


CLASSES = np.array([_class_of(code) for code in range(TABLE_SIZE)] + [UNSAFE], np.uint8)
LEAD = (np.arange(256) & 0xC0) != 0x80


@dataclass
class Split:
    """The words of the safe rows of a slice: ``codes[first[i]:first[i+1]]`` index ``distinct``."""

    codes: np.ndarray
    first: np.ndarray
    distinct: list[bytes]
    unsafe: np.ndarray


def split(part: Slice, clip: bool) -> Split:
    """Words of each row; ``clip``: lower-cased, white space dropped, digits single."""
    text = part.data.tobytes().decode()
    if clip:  # the only letter whose lower case is two code points; its rows are unsafe anyway
        text = text.replace("İ", chr(TABLE_SIZE)).lower()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(text.encode(), np.uint8)
    row_at = np.concatenate([[0], np.cumsum(LEAD[part.data])])[part.offsets]
    kind = CLASSES[np.minimum(codes, TABLE_SIZE)]
    rows = len(row_at) - 1
    unsafe = np.zeros(rows, bool)
    special = (codes[:-1] == ord("<")) & (codes[1:] == ord("|")) if len(codes) else np.zeros(0, bool)
    for marks in (kind == UNSAFE, special):
        unsafe[np.searchsorted(row_at, np.flatnonzero(marks), "right") - 1] = True
    if not len(codes):
        return Split(np.zeros(0, np.int64), np.zeros(rows + 1, np.int64), [], unsafe)

    begins = np.zeros(len(codes) + 1, bool)
    begins[row_at] = True
    row_end = begins.copy()  # where a new row, or the end, lies
    begins[1:-1] |= kind[1:] != kind[:-1]
    if clip:
        begins[:-1] |= kind == NUMBER
    else:
        # the last space before a word joins it if it is U+0020, else it stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row_end[1:-1])
        begins[last] = True
        begins[last + 1] = codes[last] != 0x20
    _contractions(codes, kind, begins, row_end)
    start = np.flatnonzero(begins[:-1])
    end = np.append(start[1:], len(codes))
    if clip:
        keep = kind[start] != SPACE
        start, end = start[keep], end[keep]
    byte_at = np.append(np.flatnonzero(LEAD[data]), len(data))
    first = np.searchsorted(start, row_at)
    start, end = byte_at[start], byte_at[end]
    codes, kinds = pd.factorize(run_hash(BYTE_VALUES[data], start, end))
    example = np.empty(len(kinds), np.int64)
    example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    raw = data.tobytes()
    return Split(codes, first, [raw[a:b] for a, b in zip(start[example].tolist(), end[example].tolist(), strict=True)], unsafe)


def _contractions(codes: np.ndarray, kind: np.ndarray, begins: np.ndarray, row_end: np.ndarray) -> None:
    """An apostrophe that starts a word takes the contraction behind it; what follows starts anew."""
    at = np.flatnonzero((codes == ord("'")) & begins[:-1])
    padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
    ends = np.concatenate([row_end, np.ones(2, bool)])
    for ending in CONTRACTIONS:
        hit = at
        for k, letter in enumerate(ending, 1):
            hit = hit[(padded[hit + k] == ord(letter)) & ~ends[hit + k]]
        begins[hit + 1] = False
        begins[hit + 1 + len(ending)] = True


def gather(codes: np.ndarray, lists: list) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of lists[c] for each of ``codes``, and each one's length."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for some in lists for x in some), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    own = lengths[codes]
    where = np.repeat(starts[codes] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    return flat[where], own


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    spare: Iterator[int] = iter(range(256, 512))
    return {b: shown.get(b) or chr(next(spare)) for b in range(256)}
