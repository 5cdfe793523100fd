"""Elias-Fano coded monotone sequences and the levels of an n-gram trie built from them, on memory-mapped words.

Defined cases: an empty sequence, level or trie finds nothing; values repeat at will in a sequence, not within a level.
"""

from __future__ import annotations

import tempfile

import numpy as np

_ONE = np.uint64(1)


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in an unnamed temporary file that is memory-mapped; it goes when the map is dropped."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as file:
        file.write(np.ascontiguousarray(array).tobytes())
        file.flush()
        return np.memmap(file, array.dtype, "r", shape=array.shape)


class EliasFano:
    """A sorted sequence of n values below 2**width: low bits packed, high bits in unary with a rank directory."""

    def __init__(self, values: np.ndarray, width: int):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        self.low_bits = low = min(63, max(0, width - max(0, n.bit_length() - 1)))
        self.low_mask = np.uint64((1 << low) - 1)
        words = np.zeros(n * low // 64 + 2, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        lows = values & self.low_mask
        np.bitwise_or.at(words, word, lows << shift)
        over = (shift + np.uint64(low)) > 64
        np.bitwise_or.at(words, word[over] + 1, lows[over] >> (np.uint64(64) - shift[over]))
        high = (values >> np.uint64(low)).astype(np.int64)
        buckets = (1 << max(0, width - low)) if n else 1
        flags = np.zeros((n + buckets) // 64 * 64 + 64, np.uint8)
        flags[high + np.arange(n)] = 1
        upper = np.packbits(flags, bitorder="little").view(np.uint64)
        self.zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))))
        self.ones = np.arange(1, len(self.zeros)) * 64 - self.zeros[1:]
        self.words, self.upper = mapped(words), mapped(upper)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th zeros (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        rest = k - self.zeros[word]
        free = ~np.asarray(self.upper)[word]
        position = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            below = (free >> position.astype(np.uint64)) & np.uint64((1 << step) - 1)
            count = np.bitwise_count(below).astype(np.int64)
            skip = rest >= count
            rest = np.where(skip, rest - count, rest)
            position = np.where(skip, position + step, position)
        return word * 64 + position

    def low(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        first = self.words[word] >> shift
        second = np.where(shift > 0, self.words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & self.low_mask

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index range of the values with these high bits."""
        begin = np.where(high > 0, self._select_zero(np.maximum(high - 1, 0)) + 1 - high, 0)
        return begin, self._select_zero(high) - high

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Indices of the first values not below x within x's bucket (its end if none)."""
        x = x.astype(np.uint64)
        low = x & self.low_mask
        left, right = self.bucket((x >> np.uint64(self.low_bits)).astype(np.int64))
        while (open_ := left < right).any():
            middle = (left + right) >> 1
            less = open_ & (self.low(np.minimum(middle, max(self.n - 1, 0))) < low)
            left, right = np.where(less, middle + 1, left), np.where(open_ & ~less, middle, right)
        return left

    def index(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it is not in the sequence."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        x = x.astype(np.uint64)
        at = self.successor(x)
        _, end = self.bucket((x >> np.uint64(self.low_bits)).astype(np.int64))
        inside = at < end
        same = inside & (self.low(np.minimum(at, self.n - 1)) == (x & self.low_mask))
        return np.where(same, at, -1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at indices: high bits by the rank of the i-th one."""
        word = np.searchsorted(self.ones, i, side="right")
        rest = i - np.where(word > 0, self.ones[np.maximum(word - 1, 0)], 0)
        bits = np.asarray(self.upper)[word]
        position = np.zeros(len(i), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> position.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            skip = rest >= count
            rest, position = np.where(skip, rest - count, rest), np.where(skip, position + step, position)
        return ((word * 64 + position - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low(i)


#: Log codes reach down to 10 ** -DECADES and are finer the nearer a probability is to 1.
DECADES, FINE = 13.0, 1000.0
_SCALE = 65534 / np.log1p(FINE * DECADES)


def log_codes(values: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities in (0, 1]; 0 is left for none.

    One scale serves all shards, so no codebook has to travel.  A code is within 0.0004
    decade of its value at 10 ** -5, and within 0.0000001 at 1.
    """
    return (np.minimum(np.rint(np.log1p(-np.log10(np.minimum(values, 1.0)) * FINE) * _SCALE), 65534) + 1).astype(np.uint16)


def log_values(codes: np.ndarray, none: float) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-np.expm1((codes.astype(float) - 1) / _SCALE) / FINE), none)


class Level:
    """A trie level: monotone pointers from numbered contexts to their successors, which are increasing within a context."""

    def __init__(self, context_index: np.ndarray, successors: np.ndarray, contexts: int, bits: int):
        """(context_index, successor) sorted and distinct; successors below 2**bits."""
        self.bits = np.uint64(bits)
        ends = np.cumsum(np.bincount(context_index, minlength=contexts))
        self.pointers = EliasFano(np.concatenate(([0], ends)), max(1, int(len(successors)).bit_length()))
        self.successors = EliasFano((context_index.astype(np.uint64) << self.bits) | successors.astype(np.uint64), bits + max(1, contexts.bit_length()))

    def find(self, context_index: np.ndarray, many: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Places of successors, ``many`` for each context, between its two pointers; -1 where there is none, or no context (-1).

        The search for the first place not below a successor stays inside the context's
        range and inside the high-bit bucket of the successor relative to the context.
        """
        coded = self.successors
        if not coded.n or not len(successors):
            return np.full(len(successors), -1, np.int64)
        known = np.maximum(context_index, 0)
        begin, end = (self.pointers.at(known + k).astype(np.int64) for k in (0, 1))
        begin, end = np.repeat(np.where(context_index >= 0, begin, 0), many), np.repeat(np.where(context_index >= 0, end, 0), many)
        wanted = (np.repeat(known, many).astype(np.uint64) << self.bits) | successors.astype(np.uint64)
        low = wanted & coded.low_mask
        left, right = coded.bucket((wanted >> np.uint64(coded.low_bits)).astype(np.int64))
        left, right = np.maximum(left, begin), np.minimum(right, end)
        last = right
        while (open_ := left < right).any():
            middle = (left + right) >> 1
            less = open_ & (coded.low(np.minimum(middle, coded.n - 1)) < low)
            left, right = np.where(less, middle + 1, left), np.where(open_ & ~less, middle, right)
        same = (left < last) & (coded.low(np.minimum(left, coded.n - 1)) == low)
        return np.where(same, left, -1)


class Trie:
    """Two levels under the root: contexts and their successors, with quantised probabilities.

    A successor's probability is its count over its context's count plus ``smoothing``; the
    rest, smoothing / (count + smoothing), is the weight of the lower order.  Words are
    numbered within the trie by their codes of 48 bits.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, context: np.ndarray, word: np.ndarray, counts: np.ndarray, totals: np.ndarray, smoothing: float):
        """Sorted distinct ``contexts`` and ``words``; (context, word) indices sorted and distinct, with training counts; totals of contexts."""
        self.contexts, self.words = EliasFano(contexts, 64), EliasFano(words, 48)
        self.pairs = Level(context, word, len(contexts), max(1, int(len(words)).bit_length()))
        self.weights, self.codes = mapped(log_codes(smoothing / (totals + smoothing))), mapped(log_codes(counts / (totals[context] + smoothing)))

    @staticmethod
    def _taken(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(len(at), np.uint16)
        return np.where(at >= 0, np.asarray(codes)[np.maximum(at, 0)], 0).astype(np.uint16)

    def lookup(self, contexts: np.ndarray, many: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (0: none) of the contexts' weights and of the probabilities of ``words``, ``many`` for each context, from the root down."""
        context = self.contexts.index(contexts)
        return self._taken(self.weights, context), self._taken(self.codes, self.pairs.find(context, many, self.words.index(words)))
