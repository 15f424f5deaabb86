"""FM-index over a run of symbols: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

STEP = 8  # every so many positions are sampled


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix positions in order. Symbol 0 separates: each 0 is smaller than all other symbols, and zeros compare by position.

    Symbols are packed into words for a first sort, then ties are broken by the ranks of the suffixes that
    follow, of twice the length in every round; only positions that are still tied take part.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    live = np.flatnonzero(text)
    depth = max(1, 62 // bits)
    key = np.zeros(len(live), np.int64)
    open_ = np.ones(len(live), bool)
    for k in range(depth):
        symbol = text[np.minimum(live + k, n - 1)].astype(np.int64) * open_
        open_ &= symbol > 0
        key = (key << bits) | symbol
    order = np.argsort(key)
    sa = np.concatenate([zeros, live[order]])
    key = key[order]
    rank = np.empty(n, np.int64)
    rank[zeros] = np.arange(len(zeros))
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(zeros), n), 0)) if len(key) else np.zeros(0, np.int64)
    rank[sa[len(zeros):]] = start
    # A suffix whose known prefix has a separator is tied only with earlier or later places of the same words.
    following = zeros[np.minimum(np.searchsorted(zeros, np.arange(n)), max(len(zeros) - 1, 0))] if len(zeros) else np.full(n, n)
    tied = np.flatnonzero(_shared(fresh)) + len(zeros)
    while len(tied):
        at = sa[tied]
        ended = following[at] - at < depth
        then = np.where(ended, at, rank[np.minimum(at + depth, n - 1)])
        key = rank[at] * (n + 1) + then
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[tied] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at] = start
        tied = tied[_shared(fresh)]
        depth *= 2
    return sa


def _shared(fresh: np.ndarray) -> np.ndarray:
    """Which rows share their key with a neighbour, given which rows begin a key."""
    alone = fresh.copy()
    if len(fresh):
        alone[:-1] &= fresh[1:]
    return ~alone


class FmIndex:
    """Index of a text of symbols 0..sigma - 1 that ends with the separator 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n, self.bits = len(text), max(1, int(sigma - 1).bit_length())
        sa = suffix_order(text, self.bits)
        self.last = text[sa - 1]  # the symbol before each suffix, in suffix order
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # Walks stop at sampled places, and at words after a separator, where no step leads back.
        marked = (sa % STEP == 0) | (self.last == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(marked, dtype=np.int32)])
        self.samples = sa[marked].astype(np.int32)
        self.levels = []
        symbols = self.last
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, self.n - int(ones[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(sigma)
        self.origin = self._down(every, np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, ones, zeros in self.levels:
            below = ones[at]
            at = np.where(symbol >> b & 1, zeros + below, at - below)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the last column."""
        return self._down(symbol, at) - self.origin[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges that begin with each row of symbols (none of them 0), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        active = np.arange(len(phrases))
        c = phrases[:, -1]
        a, b = self.before[c], self.before[c + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            found = a < b
            active, a, b = active[found], a[found], b[found]
            c = phrases[active, j]
            a, b = self.before[c] + self.rank(c, a), self.before[c] + self.rank(c, b)
        lo[active], hi[active] = a, b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to a sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            i = at[open_]
            known = self.sample_rank[i + 1] > self.sample_rank[i]
            done = open_[known]
            out[done] = self.samples[self.sample_rank[i[known]]] + steps[done]
            open_, i = open_[~known], i[~known]
            c = self.last[i]
            at[open_] = self.before[c] + self.rank(c, i)
            steps[open_] += 1
        return out
