"""An FM-index of a sequence of small numbers: suffix order, wavelet matrix with ranks, sampled positions. Everything is vectorised over queries.

Symbol 0 separates segments: no phrase holds it, and suffixes are ordered only as far as the next one (equal ones by position, as if each separator were a
symbol of its own). The sequence must begin and end with 0.
"""

from __future__ import annotations

import numpy as np

#: Every so many places, and at the start of each segment, the index keeps a suffix's position.
SAMPLE = 8


def suffix_order(t: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of their suffixes: one sort by as many symbols as a 63-bit key holds, then doubling among those still equal."""
    n, width = len(t), 63 // bits
    key, alive = t.copy(), t != 0
    padded = np.concatenate([t, np.zeros(width, t.dtype)])
    for i in range(1, width):
        nxt = padded[i : i + n]
        alive &= nxt != 0
        key = (key << bits) | np.where(alive, nxt, 0)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | ~alive[order][1:]
    rank = np.empty(n, np.int64)
    while True:
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if len(slots) == 0:
            return order
        part = order[slots]
        first, second = rank[part], rank[part + width]
        by = np.lexsort((second, first))
        order[slots] = part[by]
        first, second = first[by], second[by]
        new[slots[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[slots[0]] = True
        width *= 2


class Bits:
    """A bit vector with the count of ones before any place: 64-bit words and a running count for each."""

    def __init__(self, values: np.ndarray):
        packed = np.packbits(values, bitorder="little")
        self.words = np.zeros((len(values) >> 6) + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class FMIndex:
    def __init__(self, t: np.ndarray, bits: int):
        order = suffix_order(t, bits)
        last = t[order - 1]
        self.bits = bits
        self.first = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(t, minlength=1 << bits), out=self.first[1:])
        self.levels, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (last >> level) & 1 != 0
            self.levels.append(Bits(one))
            self.zeros.append(len(last) - int(one.sum()))
            last = np.concatenate([last[~one], last[one]])
        self.start = np.zeros(1 << bits, np.int64)  # where each symbol begins below the last level
        self.start = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))
        kept = (order % SAMPLE == 0) | (t[order - 1] == 0)
        self.sampled, self.positions = Bits(kept), order[kept]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.rank(i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1 != 0, zeros + ones, i - ones)
        return i - self.start[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases (a row each, of equal lengths): the rows that occur, and the interval of suffixes that begin with each."""
        which = np.arange(len(phrases))
        symbol = phrases[:, -1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            there = low < high
            which, low, high = which[there], low[there], high[there]
            symbol = phrases[which, k]
            low, high = self.first[symbol] + self._down(symbol, low), self.first[symbol] + self._down(symbol, high)
        there = low < high
        return which[there], low[there], high[there]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by stepping back to the next one whose position is kept."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            kept = self.sampled.get(rows)
            out[todo[kept]] = self.positions[self.sampled.rank(rows[kept])] + steps
            todo, rows, steps = todo[~kept], rows[~kept], steps + 1
            symbol, i = np.zeros(len(rows), np.int64), rows
            for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
                one, ones = level.get(i), level.rank(i)
                symbol |= one.astype(np.int64) << (self.bits - 1 - k)
                i = np.where(one, zeros + ones, i - ones)
            rows = self.first[symbol] + i - self.start[symbol]
        return out
