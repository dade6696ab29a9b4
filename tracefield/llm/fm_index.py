"""A compressed full-text index over sequences of symbols.

The Burrows-Wheeler transform of a text is held as a wavelet matrix: one bit
vector for each bit of the symbols. A vector is cut into blocks of 256 bits;
blocks of zeros or ones alone, of which the transform of a repetitive text has
many, are not stored but for a count. Backward search narrows the interval of suffixes that begin with a
pattern, one symbol at a time from its end, for many patterns at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with constant-time rank, without their uniform blocks."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // 256 + 1
        padded = np.zeros(blocks * 256, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view("<u8").reshape(blocks, 4)
        ones = np.bitwise_count(words).astype(np.int32)
        total = ones.sum(1)
        self.before = np.zeros(blocks, np.int32 if len(bits) < 1 << 31 else np.int64)
        np.cumsum(total[:-1], out=self.before[1:])
        kept = (total > 0) & (total < 256)
        # Blocks of zeros share one stored block, and those of ones another.
        self.words = np.concatenate([np.zeros(4, "<u8"), np.full(4, ~np.uint64(0)), words[kept].ravel()])
        inner = np.concatenate([[0, 0, 0, 0, 0, 64, 128, 192], (np.cumsum(ones[kept], axis=1) - ones[kept]).ravel()])
        self.inner = inner.astype(np.uint8)  # ones before each word in its block
        self.slot = np.where(total == 256, 1, 0).astype(np.int32)
        self.slot[kept] = np.arange(2, 2 + kept.sum())

    @property
    def nbytes(self) -> int:
        return self.before.nbytes + self.words.nbytes + self.inner.nbytes + self.slot.nbytes

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The number of ones among the first ``i`` bits."""
        block = i >> 8
        word = (self.slot[block].astype(np.int64) << 2) | ((i >> 6) & 3)
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + self.inner[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """A sequence of symbols below ``1 << levels`` with rank of any symbol."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.vectors, self.zeros = levels, [], []
        now = symbols
        for k in range(levels - 1, -1, -1):
            bits = (now >> k) & 1
            self.vectors.append(BitVector(bits.astype(np.uint8)))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        # Where each symbol's own places begin on the last level, which lists the symbols by their reversed bits.
        every = np.arange(1 << levels) if len(symbols) >= 1 << levels else np.unique(symbols, return_counts=True)[0]
        self.start = np.zeros(1 << levels, np.int64)
        self.start[every] = self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (vector, zeros) in enumerate(zip(self.vectors, self.zeros)):
            ones = vector.rank(i)
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol (of the sequence) stands before ``lo`` and before ``hi``."""
        n, start = len(symbol), self.start[symbol]
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return both[:n] - start, both[n:] - start


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the suffixes' first ``depth`` symbols at least (prefix doubling)."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, order, have = rank.astype(np.int64), np.argsort(rank, kind="stable"), 1
    while have < depth and n:
        key = rank * (n + 1)
        key[:-have] += rank[have:] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        have *= 2
        if n and rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """The index of ``text`` (symbols 1..; 0 parts sequences) for patterns of up to ``depth`` symbols.

    ``twice``: places of the text that stand for two occurrences.
    """

    def __init__(self, text: np.ndarray, depth: int, twice: np.ndarray | None = None):
        text = np.append(text, 0)
        order = suffix_array(text, depth)
        top = int(text.max())
        self.size = len(text)
        self.matrix = WaveletMatrix(text[order - 1], max(1, top.bit_length()))
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.first[1:])
        self.more = None if twice is None else BitVector(np.append(twice, False)[order].astype(np.uint8))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with ``symbol`` (of the text) put before them."""
        a, b = self.matrix.ranks(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How often the patterns of these intervals occur."""
        n = hi - lo
        return n if self.more is None else n + self.more.rank(hi) - self.more.rank(lo)

    def matching_lengths(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: for each end in ``text``, the length (up to ``most``) of the longest run before it that occurs ``least`` times in the index."""
        length = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(most > 0)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        while len(live):
            lo, hi = self.extend(text[ends[live] - 1 - length[live]], lo, hi)
            ok = self.occurrences(lo, hi) >= least
            live, lo, hi = live[ok], lo[ok], hi[ok]
            length[live] += 1
            more = length[live] < most[live]
            live, lo, hi = live[more], lo[more], hi[more]
        return length
