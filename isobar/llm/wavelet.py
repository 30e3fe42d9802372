"""A compressed full-text index of numbers in numpy: suffix order, wavelet matrix and backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector packed in 64-bit words, with counts before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the depth symbols that begin there: prefix doubling, which stops once all differ."""
    n, k = len(symbols), 1
    rank = symbols.astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else rank
        k *= 2
        if k >= depth or not n or rank[order[-1]] == n - 1:
            return order


class Index:
    """FM-index of numbers 0..top: the last symbols in suffix order, in a wavelet matrix.

    Suffixes are ordered by depth symbols, so patterns of up to depth symbols are counted exactly.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        order = suffix_order(symbols, depth)
        last = symbols[order - 1]
        self.n = len(symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.levels, self.width = [], max(1, int(symbols.max(initial=0)).bit_length())
        for level in range(self.width - 1, -1, -1):
            bit = (last >> level & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit)))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.block = np.zeros(len(self.first) - 1, np.int64)  # where each symbol begins in the lowest level
        present = np.flatnonzero(np.diff(self.first))
        self.block[present] = self.rank(present, np.zeros(len(present), np.int64), absolute=True)

    def rank(self, symbol: np.ndarray, at: np.ndarray, absolute: bool = False) -> np.ndarray:
        """How often each symbol stands before a place of the last column."""
        at = at.copy()
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at if absolute else at - self.block[symbol]

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the pattern that has one more symbol in front."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.first[symbol], 2)
        return both[: len(symbol)], both[len(symbol) :]


def repeated(index: Index, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(document, from, to): starts, inclusive and relative, of the windows of size symbols that the index holds twice.

    Documents are stretches of symbols, streamed from the right: backward search gives the longest match that ends at a place
    and is found twice (its matching statistic). Windows inside a long enough match are reported; the search goes on
    one place to the left of the match's last window, or, after a short match, one end further left.
    """
    out = []
    doc, end = np.arange(len(starts)), stops.copy()
    at = end.copy()
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), index.n, np.int64)
    while len(doc):
        symbol = symbols[at - 1]
        fresh = at == end
        new_low, new_high = index.first[symbol], index.first[symbol + 1]
        old = np.flatnonzero(~fresh)
        if len(old):
            new_low[old], new_high[old] = index.back(symbol[old], low[old], high[old])
        good = new_high - new_low >= 2
        low, high = np.where(good, new_low, low), np.where(good, new_high, high)
        at = at - good
        over = np.flatnonzero(~good | (at == starts[doc]))
        if len(over):
            long = over[end[over] - at[over] >= size]
            out += zip(doc[long].tolist(), (at[long] - starts[doc[long]]).tolist(), (end[long] - size - starts[doc[long]]).tolist(), strict=True)
            next_end = end.copy()
            next_end[over] = np.where(end[over] - at[over] >= size, at[over] + size - 1, end[over] - 1)
            keep = next_end - starts[doc] >= size
            at[over] = next_end[over]
            doc, end, at, low, high = doc[keep], next_end[keep], at[keep], low[keep], high[keep]
    return out
