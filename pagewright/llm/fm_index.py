"""An FM-index over integer symbols: suffix order, Burrows-Wheeler transform, wavelet ranks, sampled positions.

All searches are vectorised: one call narrows the row ranges of many patterns, or
walks many rows to their nearest sampled suffix.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit words and running counts."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(counts[:-1], dtype=np.int64)))
        self.ones = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: one rank vector per bit of the symbols, high bits first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            flags = ((symbols >> shift) & 1).astype(np.uint8)
            bits = Bits(flags)
            self.levels.append((shift, bits, len(symbols) - bits.ones))
            one = flags.astype(bool)
            symbols = np.concatenate((symbols[~one], symbols[one]))
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, i) - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and their ranks there."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            bit, ones = bits.get(i).astype(np.int64), bits.rank(i)
            symbol |= bit << shift
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i - self.start[symbol]


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Start positions of the suffixes in lexicographic order; ``text`` must end with a unique least symbol.

    The first sort takes as many symbols as fit a word; then the depth doubles, and
    only suffixes that still share their rank are sorted again.
    """
    n = len(text)
    bits = max(1, (sigma - 1).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key[: max(0, n - j)] |= text[j:]
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    tied = ~(fresh & np.concatenate((fresh[1:], [True])))
    slots = np.flatnonzero(tied)
    while len(slots):
        suffix = order[slots]
        after = suffix + depth
        key = rank[suffix] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key)
        suffix, key = suffix[again], key[again]
        order[slots] = suffix
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))
        rank[suffix] = slots[first]
        slots = slots[~(fresh & np.concatenate((fresh[1:], [True])))]
        depth *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        """``text``: symbols below sigma; 0 is reserved for the end, which is added here."""
        text = np.concatenate((text.astype(np.int64), [0]))
        order = suffix_order(text, sigma)
        self.n = len(text)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.wavelet = Wavelet(text[order - 1], sigma)
        sampled = order % sample == 0
        self.marks, self.samples = Bits(sampled), order[sampled]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns (one a row): (pattern number, low, high) of those that occur."""
        which = np.arange(len(patterns))
        last = patterns[:, -1]
        low, high = self.less[last], self.less[last + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            alive = high > low
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
            symbol = patterns[which, j]
            low = self.less[symbol] + self.wavelet.rank(symbol, low)
            high = self.less[symbol] + self.wavelet.rank(symbol, high)
        alive = high > low
        return which[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix, plus its position."""
        found = np.empty(len(rows), np.int64)
        waiting, steps = np.arange(len(rows)), 0
        while len(waiting):
            marked = self.marks.get(rows).astype(bool)
            found[waiting[marked]] = self.samples[self.marks.rank(rows[marked])] + steps
            waiting, rows = waiting[~marked], rows[~marked]
            symbol, rank = self.wavelet.access(rows)
            rows, steps = self.less[symbol] + rank, steps + 1
        return found
