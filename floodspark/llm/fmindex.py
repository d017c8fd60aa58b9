"""A compressed FM-index over word sequences, for many patterns at a time.

Suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix on packed bits with block counts.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``; prefixes double until all ranks differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    size = 1
    while True:
        key = rank * (n + 1)
        if size < n:
            key[:n - size] += rank[size:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        size *= 2


class Index:
    """Sequences with weights; counts how often a pattern occurs in them, weighted.

    Each sequence ends in a sign of its own, smaller than any word, so no pattern runs across.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> None:
        self.alphabet, ids = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths)
        count = len(lengths)
        owner = np.repeat(np.arange(count), lengths + 1)
        text = np.empty(len(words) + count, np.int64)
        last = ends + np.arange(count)
        inner = np.ones(len(text), bool)
        inner[last] = False
        text[inner] = ids + count
        text[last] = np.arange(count)
        order = suffix_array(text)
        symbols = np.maximum(text - count + 1, 0)  # all end signs are 0 from here on: none is asked for
        bwt = symbols[order - 1]
        self.size = len(text)
        self.sum = np.concatenate([[0], np.cumsum(weights[owner[order]])])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1))])
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in reversed(range(max(1, int(len(self.alphabet)).bit_length()))):
            ones = (bwt >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int((~ones).sum())))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        everything = np.arange(len(self.alphabet) + 1)
        self.origin = self._walk(everything, np.zeros(len(everything), np.int64))
        self.symbols = symbols[inner]

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of each pattern with ``symbol`` put before it."""
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol] - self.origin[symbol]
        return base + both[:len(symbol)], base + both[len(symbol):]

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.sum[high] - self.sum[low]


def repeated_spans(words: np.ndarray, lengths: np.ndarray, weights: np.ndarray, window: int
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Streams the sequences through their own index: ``(sequence, from, to)`` of the stretches of at least
    ``window`` words whose every window has a weight of two or more.

    For an end ``e`` backward search gives the longest repeated stretch that ends there.  If it is long
    enough its windows are done and the search goes on with the first window that sticks out of it;
    otherwise the window that ends at ``e`` is unique, and the next one ends a word earlier.
    """
    index = Index(words, lengths, weights)
    starts = np.cumsum(lengths) - lengths
    seq = np.flatnonzero(lengths >= window)
    end = lengths[seq].astype(np.int64)
    size = np.zeros(len(seq), np.int64)
    low, high = np.zeros(len(seq), np.int64), np.full(len(seq), index.size, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(seq):
        more = size < end
        symbol = index.symbols[starts[seq] + np.maximum(end - size - 1, 0)]
        new_low, new_high = index.extend(symbol, low, high)
        grows = more & (index.weight(new_low, new_high) >= 2)
        low, high = np.where(grows, new_low, 0), np.where(grows, new_high, index.size)
        stop = ~grows
        hit = stop & (size >= window)
        if hit.any():
            found.append((seq[hit], (end - size)[hit], end[hit]))
        end = np.where(hit, end - size + window - 1, np.where(stop, end - 1, end))
        size = np.where(grows, size + 1, 0)
        live = end >= window
        if not live.all():
            seq, end, size, low, high = seq[live], end[live], size[live], low[live], high[live]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))
