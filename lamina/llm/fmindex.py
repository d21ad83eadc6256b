"""An FM-index of one shard's words: suffix order, wavelet matrix of the BWT, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class ShardIndex:
    """Index of a sequence of symbols 1, 2, ... with separators 0; it ends with a separator.

    Separators sort as if all were different, by place, so suffixes compare up to their next separator only.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        sep = text == 0
        order, _ = self._suffixes(text, sep)
        self.bwt = text[order - 1]
        counts = np.bincount(text, minlength=symbols + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # suffixes that begin with a smaller symbol
        self.levels = []
        row = self.bwt
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            one = (row >> bit) & 1 == 1
            ones = np.concatenate([[0], np.cumsum(one)])
            self.levels.append((bit, ones, n - int(ones[-1])))
            row = np.concatenate([row[~one], row[one]])
        start = np.ones(n, bool)
        start[1:] = sep[:-1]
        start |= np.arange(n) % SAMPLE == 0
        self.marked = start[order]
        self.nth = np.cumsum(self.marked) - 1
        self.sampled = order[self.marked]

    @staticmethod
    def _suffixes(text: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, int]:
        """Prefix doubling until all suffixes differ."""
        n, seps = len(text), int(sep.sum())
        rank = text.astype(np.int64) + seps
        rank[sep] = np.arange(seps)
        k = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + second
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                return order, k
            k *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the BWT before each place."""
        first = np.zeros(len(at), np.int64)
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = ones[first], ones[at]
            first, at = np.where(one, zeros + a, first - a), np.where(one, zeros + b, at - b)
        return at - first

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of symbols) at once: the found ones and their ranges of rows."""
        live = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            go = np.flatnonzero(size[live] > step)
            if not len(go):
                break
            c = phrases[live[go], size[live[go]] - 1 - step].astype(np.int64)
            lo[go] = self.before[c] + self.rank(c, lo[go])
            hi[go] = self.before[c] + self.rank(c, hi[go])
            keep = lo < hi
            live, lo, hi = live[keep], lo[keep], hi[keep]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes at these rows: steps back to the next sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.marked[at[open_]]
            hit = open_[done]
            out[hit] = self.sampled[self.nth[at[hit]]] + steps[hit]
            open_ = open_[~done]
            c = self.bwt[at[open_]]
            at[open_] = self.before[c] + self.rank(c, at[open_])
            steps[open_] += 1
        return out
