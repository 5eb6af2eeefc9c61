"""Vectorised words: boundaries and 64-bit hashes of all words of a batch of texts by a few numpy passes over its bytes.

A word is a maximal run of ASCII letters, ASCII digits and characters outside ASCII, other than U+0080-U+00BF,
U+2000-U+207F and U+3000-U+303F. WORD is the same as a regular expression. Case is folded by pyarrow's utf8_lower,
which keeps the number of characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = "[0-9A-Za-zÀ-῿₀-⿿぀-\U0010ffff]+"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CLASS = np.zeros(256, bool)
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _CLASS[_c] = True
_CLASS[0x80:] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base, and of its inverse modulo 2**64, for at least n places."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 20)
        factors = np.full(n, _BASE, np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
        factors[1:] = _INVERSE
        _inverses = np.multiply.accumulate(factors)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def offsets_of(text: pa.Array) -> np.ndarray:
    """The n + 1 byte offsets of a large_string array, from 0."""
    if len(text) == 0:
        return np.zeros(1, np.int64)
    o = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    return o - o[0]


def bytes_of(text: pa.Array) -> np.ndarray:
    """The bytes that offsets_of() counts."""
    if len(text) == 0 or text.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    o = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(text.buffers()[2], np.uint8)[o[0] : o[-1]]


class Prefix:
    """Prefix sums that give the hash of any slice of a sequence in constant time."""

    def __init__(self, values: np.ndarray):
        powers, self.inverse = _tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def words(text: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Hashes, byte starts and byte ends of all words in order, per text the index of its first word (n + 1 of them), and the folded text. Nulls count as empty."""
    text = pc.fill_null(text, "")
    if fold:
        text = pc.utf8_lower(text)
    offsets, data = offsets_of(text), bytes_of(text)
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(text) + 1, np.int64), text
    inside = _CLASS[data]
    p = np.flatnonzero(data == 0xC2)
    inside[p] = inside[p + 1] = False
    for lead, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        p = np.flatnonzero(data[:-1] == lead)
        for s in seconds:
            q = p[data[p + 1] == s]
            for k in range(3):
                inside[q + k] = False
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    at = offsets[:-1]
    before[at[at < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    to = offsets[1:]
    after[to[to > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Prefix(data).hash(starts, ends), starts, ends, np.searchsorted(starts, offsets), text


def char_index(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Character positions within their texts of the byte positions `at` in texts `row`."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[at] - lead[offsets[row]]
