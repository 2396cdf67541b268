"""A compressed FM-index over short sequences of integers: Burrows-Wheeler transform in a wavelet matrix.

All that stays is the matrix's bits with their ranks, and a few counts a symbol. Suffixes are sorted by as many symbols
as the longest pattern has, which leaves the ranges of all patterns up to that length whole.
Built and searched with whole-array operations: a search runs for many patterns in step.
"""

from __future__ import annotations

import numpy as np


#: The k lowest bits set, for k from 0 to 63.
_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)
#: Patterns that are searched in step.
STEP = 32768


class Bits:
    """A bit vector with ranks: 64 bits to a word, and the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, bool)
        self.words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        low = _BELOW.take(at & 63)
        return self.before.take(word) + np.bitwise_count(self.words.take(word) & low)


class FMIndex:
    """Index of sequences for patterns of at most ``longest`` symbols; symbols are 1 to ``top``.

    A separator stands after each sequence; separators differ from each other in the suffix order, by sequence number,
    and are one symbol, 0, in the transform. ``owners``: a number of each sequence, kept in suffix order.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, owners: np.ndarray, longest: int):
        n_seq, self.top = len(sizes), int(flat.max(initial=0))
        text = np.zeros(len(flat) + n_seq, np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(n_seq), sizes)] = flat
        stops, n = np.cumsum(sizes) + np.arange(n_seq), len(text)
        rank = text + n_seq
        rank[stops] = np.arange(n_seq)
        step = 1
        while step < longest:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            _, rank = np.unique(rank * np.int64(n + n_seq + self.top + 2) + after, return_inverse=True)
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.owners = owners[np.repeat(np.arange(n_seq), sizes + 1)][order]
        bwt = text[order - 1]
        counts = np.bincount(text, minlength=self.top + 2)
        self.first = np.cumsum(counts) - counts
        self.last = self.first + counts
        self.bits, base, symbols = [], np.zeros(self.top + 2, np.int64), np.arange(self.top + 2)
        self.levels = max(1, self.top.bit_length())
        for level in range(self.levels - 1, -1, -1):
            ones = (bwt >> level & 1).astype(bool)
            bits = Bits(ones)
            self.bits.append(bits)
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
            up = bits.ones(base)
            base = np.where(symbols >> level & 1, bits.zeros + up, base - up)
        self.base = base  # where each symbol's run starts at the matrix's foot

    def back(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: ranges of each pattern with a symbol put before it."""
        at = np.concatenate([lo, hi])
        both = np.concatenate([symbols, symbols]).astype(np.int32)
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            up = bits.ones(at)
            at = np.where(both >> level & 1, bits.zeros + up, at - up)
        move = self.first[symbols] - self.base[symbols]
        return at[: len(lo)] + move, at[len(lo) :] + move

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, limit: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a stream: for the places ``ends`` (one past a match's last symbol), how many symbols before it
        match the index in ``least`` places or more, ``limit`` symbols at most, and the range of these places. Symbols that the index
        lacks are 0."""
        parts = [self._statistics(symbols, ends[k : k + STEP], limit, least) for k in range(0, len(ends), STEP)]
        size, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else np.zeros((3, 0), np.int64)
        return size, lo, hi

    def _statistics(self, symbols: np.ndarray, ends: np.ndarray, limit: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        on = np.arange(len(ends))
        for k in range(1, limit + 1):
            on = on[ends[on] >= k]
            s = symbols[ends[on] - k]
            on, s = on[s > 0], s[s > 0]
            a, b = (self.first[s], self.last[s]) if k == 1 else self.back(s, lo[on], hi[on])
            found = b - a >= least
            on = on[found]
            lo[on], hi[on], size[on] = a[found], b[found], k
        return size, lo, hi

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner in each range; ranges must be of patterns of one length, so they are equal or apart."""
        order = np.argsort(lo, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], lo[order][1:] != lo[order][:-1]]))
        bounds = np.empty(2 * len(cut), np.int64)
        bounds[0::2], bounds[1::2] = lo[order][cut], hi[order][cut]
        least = np.minimum.reduceat(np.append(self.owners, np.iinfo(np.int64).max), bounds)[0::2]
        out = np.empty(len(lo), np.int64)
        out[order] = np.repeat(least, np.diff(np.append(cut, len(order))))
        return out
