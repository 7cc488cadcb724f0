"""A compressed FM-index over integer sequences (wavelet matrix on packed
bitmaps), searched for many patterns at once in numpy.

Rows are ordered by the first ``depth`` symbols only, which gives exact
intervals for patterns of up to ``depth`` symbols.
"""

from __future__ import annotations

import numpy as np


class Bitmap:
    """Bits with constant-time rank: 64-bit words and a running count."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[int, Bitmap, int]] = []
        cur = seq
        for shift in range(self.bits - 1, -1, -1):
            b = (cur >> shift) & 1
            one = b.astype(bool)
            zeros = len(cur) - int(np.count_nonzero(one))
            self.levels.append((shift, Bitmap(b), zeros))
            cur = np.concatenate([cur[~one], cur[one]])
        # where each symbol begins in the last level
        self.begin = np.full(1 << self.bits, 0, np.int64)
        codes, at = np.unique(cur, return_index=True)
        self.begin[codes] = at

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol (one that occurs) before position i."""
        at = i
        for shift, bitmap, zeros in self.levels:
            one = bitmap.ones(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + one, at - one)
        return at - self.begin[symbol]


def _pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


class FMIndex:
    """Index of sequences that are joined with the symbol 0 after each."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = len(text)
        rank, span = text.astype(np.int64), 1

        def later(r, k):
            out = np.zeros(n, np.int64)
            out[:max(0, n - k)] = r[k:] + 1
            return out

        while span < depth:
            step = min(span, depth - span)
            rank = _pair_rank(rank, later(rank, step))
            span += step
        self.order = np.argsort(rank, kind="stable")
        self.text_size = n
        bwt = text[self.order - 1]  # the symbol before the first is the last, a 0
        self.wavelet = WaveletMatrix(bwt, sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, depth: int):
        """For each end (exclusive position in ``stream``): how many symbols
        before it, ``depth`` at most, occur somewhere else in the index too, and the
        interval (in suffix order) of that match."""
        c = stream[ends - 1]
        lo, hi = self.first[c].astype(np.int64), self.first[c + 1].astype(np.int64)
        length = np.ones(len(ends), np.int64)
        live = np.flatnonzero(hi - lo > 1)
        for step in range(2, depth + 1):
            if not len(live):
                break
            c = stream[ends[live] - step]
            a = self.first[c] + self.wavelet.rank(c, lo[live])
            b = self.first[c] + self.wavelet.rank(c, hi[live])
            more = b - a > 1
            live = live[more]
            lo[live], hi[live], length[live] = a[more], b[more], step
        return length, lo, hi
