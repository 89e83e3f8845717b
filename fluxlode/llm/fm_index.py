"""A compressed FM-index over small symbols: a wavelet matrix of packed bits over the BWT, searched for many patterns at once.

Only the BWT is kept; the suffix array that orders it is dropped when the index is built."""

from __future__ import annotations

import numpy as np

BITS = 4
DEPTH = 32  # suffixes are ordered by so many symbols; patterns may be as long


class Bits:
    """A bit vector in 64-bit words with the count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.int32)
        self.zeros = len(bits) - int(np.bitwise_count(self.words).sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """symbols: 0 (a separator, in no pattern, and the last symbol) to 2**BITS-1."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        padded = np.zeros(n + DEPTH, np.uint64)
        padded[:n] = symbols
        keys = []
        for a in range(0, DEPTH, 64 // BITS):
            key = np.zeros(n, np.uint64)
            for j in range(a, a + 64 // BITS):
                key = (key << np.uint64(BITS)) | padded[j : j + n]
            keys.append(key)
        bwt = symbols[np.lexsort(keys[::-1]) - 1]
        self.size = n
        self.first = np.r_[0, np.cumsum(np.bincount(bwt, minlength=1 << BITS))].astype(np.int64)
        self.levels, now = [], bwt
        for level in range(BITS - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(Bits(bit))
            now = np.r_[now[bit == 0], now[bit == 1]]
        self.begin = self._begins()

    def _begins(self) -> np.ndarray:
        """Where each symbol's run begins after the last level."""
        out = np.zeros(1 << BITS, np.int64)
        for c in range(1 << BITS):
            at = np.zeros(1, np.int64)
            for level, bits in zip(range(BITS - 1, -1, -1), self.levels):
                ones = bits.rank(at)
                at = bits.zeros + ones if (c >> level) & 1 else at - ones
            out[c] = at[0]
        return out

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c[k] in the BWT before i[k]."""
        at = i
        for level, bits in zip(range(BITS - 1, -1, -1), self.levels):
            ones = bits.rank(at)
            at = np.where((c >> level) & 1 == 1, bits.zeros + ones, at - ones)
        return at - self.begin[c]

    def repeated(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, begin of its interval) of the patterns symbols[start:start+length] that occur at least twice in the index:
        those whose matching statistics reach `length`. Equal patterns, and no others, have the same interval.

        Backward search with all patterns in step; one whose interval has a single suffix left matches nothing
        but itself and is done."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        for t in range(length - 1, -1, -1):
            c = symbols[starts + t].astype(np.int64)
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            more = high - low > 1
            starts, low, high = starts[more], low[more], high[more]
        return starts, low
