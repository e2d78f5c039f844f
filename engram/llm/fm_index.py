"""A compressed FM-index over whole numbers, with batched backward search.

Suffixes are sorted by their first ``width`` symbols only (a width-bounded transform),
which is all that patterns of up to ``width`` symbols need.  The transform is kept as a
wavelet matrix: one bit per symbol and level, packed into 64-bit words with a running
count per word.  All searches take arrays: each numpy call answers one step of every
pattern.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class _Bits:
    """A packed bit row with rank."""

    __slots__ = ("words", "ones", "zeros")

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.zeros = len(bits) - int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        word = at >> 6
        below = self.words[word] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
        return self.ones[word] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int) -> None:
        """``symbols`` are below ``size``."""
        self.bits = max(1, int(size - 1).bit_length())
        self.rows: list[_Bits] = []
        row = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.rows.append(_Bits(bit))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.begin = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, row in zip(range(self.bits - 1, -1, -1), self.rows):
            ones = row.rank(at)
            at = np.where((symbol >> level) & 1, row.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of times each symbol occurs before each position."""
        return self._walk(symbol, at) - self.begin[symbol]


def _dense(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of ranks, and their dense ranks."""
    key = first * (n + 1) + second
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
    return order, rank


class FMIndex:
    """Over ``text``, whole numbers below ``size``, for patterns of up to ``width`` >= 2 symbols."""

    def __init__(self, text: np.ndarray, size: int, width: int) -> None:
        n = len(text)
        self.n, self.width = n, width

        def shifted(rank: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: max(n - by, 0)] = rank[by:] + 1
            return out

        rank, have = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while have * 2 < width:
            rank, have = _dense(rank, shifted(rank, have), n)[1], have * 2
        # prefixes of two overlapping known lengths order any length up to their sum
        self.suffixes, whole = _dense(rank, shifted(rank, width - have), n)
        shorter = _dense(rank, shifted(rank, width - 1 - have), n)[1] if width - 1 > have else rank
        self.transform = WaveletMatrix(text[self.suffixes - 1], size)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.group = whole[self.suffixes]  # equal where ``width`` symbols are
        edge = np.concatenate(([True], np.diff(shorter[self.suffixes]) != 0))
        starts = np.flatnonzero(edge)
        which = np.cumsum(edge) - 1
        self.low, self.high = starts[which], np.concatenate((starts[1:], [n]))[which]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with ``symbol`` put before them."""
        both = self.transform.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.first[symbol] + both[: len(symbol)], self.first[symbol] + both[len(symbol) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns of ``width`` symbols without their last one."""
        return self.low[low], self.high[low]
