"""An FM-index over a sequence of word numbers, in numpy: suffix array, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes.  0 is a separator; separators differ from each other and are ordered by position, so that a
    suffix is told apart from all others by its first separator at the latest.  The last symbol must be a separator.

    Prefix doubling that sorts again only what is still tied.
    """
    n = len(symbols)
    rank = np.empty(n, np.int64)
    separators = np.flatnonzero(symbols == 0)
    rank[separators] = np.arange(len(separators))
    tied = np.flatnonzero(symbols)
    tied = tied[np.argsort(symbols[tied], kind="stable")]
    key = symbols[tied].astype(np.int64)
    old = np.full(len(tied), len(separators), np.int64)
    k = 0
    while len(tied):
        if k:
            old = rank[tied]
            key = old * n + rank[tied + k]
            order = np.argsort(key)
            tied, old, key = tied[order], old[order], key[order]
        index = np.arange(len(tied))
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        group = np.ones(len(tied), bool)
        group[1:] = old[1:] != old[:-1]
        rank[tied] = old + np.maximum.accumulate(np.where(fresh, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        alone = fresh & np.append(fresh[1:], True)
        tied = tied[~alone]
        k = 2 * k or 1
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletTree:
    """Ranks of symbols in a sequence.  Levels run from the highest bit down; each level holds, for every place, how many
    zero bits stand before it, with zeros dealt to the left and ones to the right for the next level."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros = []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            before = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:], dtype=np.int32)
            self.zeros.append(before)
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, before in enumerate(self.zeros):
            zeros = before[places]
            places = np.where((symbols >> (self.bits - 1 - level)) & 1, before[-1] + places - zeros, zeros)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, places) - self.first[symbols]


class FmIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        """symbols: from 0 (separator) to sigma - 1; a separator stands first and last."""
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.tree = WaveletTree(self.bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))]).astype(np.int64)
        # The walk back from a place ends at the start of its run at the latest: it never crosses a separator.
        kept = (order % sample == 0) | (self.bwt == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows of equal length) at once: first and last row (exclusive) of each."""
        last = patterns[:, -1]
        low, high = self.before[last].copy(), self.before[last + 1].copy()
        live = np.flatnonzero(high > low)
        for j in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[live, j]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out = np.empty(len(rows), np.int64)
        open_, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            found = self.kept[rows + 1] > self.kept[rows]
            out[open_[found]] = self.positions[self.kept[rows[found]]] + steps
            open_, rows, steps = open_[~found], rows[~found], steps + 1
            c = self.bwt[rows]
            rows = self.before[c] + self.tree.rank(c, rows)
        return out
