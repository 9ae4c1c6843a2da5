"""A word-level FM-index: suffix order, wavelet-matrix ranks, backward search, sampled locate.

Everything is numpy over whole shards and whole pattern sets; symbols are small integers,
0 separates segments and never matches.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose zeros compare as distinct (by place) and smallest.

    Prefix doubling that sorts, each round, only the suffixes still tied.  The text must
    end in a zero, so that no comparison runs past its end.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    sa = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    ordered = key[sa]
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 1
    while len(tied):
        part = sa[tied]
        group, follow = rank[part], rank[part + h]
        order = np.lexsort((follow, group))
        part, group, follow = part[order], group[order], follow[order]
        sa[tied] = part
        new = np.empty(len(tied), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        rank[part] = np.maximum.accumulate(np.where(new, tied, 0))
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        h *= 2
    return sa


class FMIndex:
    """Counts and finds patterns in a text of symbols 0..sigma-1 that ends in 0.

    ``step``: every so many-th place of a segment (its first one always) keeps its suffix
    position, so a located match walks back ``step`` times at most.  ``sa``: the suffix order, if it
    is known already.
    """

    def __init__(self, text: np.ndarray, sigma: int, step: int = 32, sa: np.ndarray | None = None):
        sa = suffix_order(text) if sa is None else sa
        n = len(text)
        last = text[sa - 1]  # the place before 0 is the final separator
        self.n, self.sigma = n, sigma
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        seq = last
        base = np.zeros(sigma, np.int64)
        symbols = np.arange(sigma)
        for b in reversed(range(bits)):
            one = ((seq >> b) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            zeros = n - int(ones[-1])
            self.levels.append((ones, zeros))
            seq = np.concatenate((seq[~one], seq[one]))
            up = ((symbols >> b) & 1).astype(bool)
            base = np.where(up, zeros + ones[base], base - ones[base])
        self.base = base
        self.last = last
        place = np.arange(n)
        heads = np.concatenate(([True], text[:-1] == 0))
        since = place - np.maximum.accumulate(np.where(heads, place, 0))
        keep = (since % step == 0)[sa]
        self.sampled = np.zeros(n + 1, np.int32)
        np.cumsum(keep, out=self.sampled[1:])
        self.samples = sa[keep]

    def step_back(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The row boundary that ``at`` maps to when ``symbols`` are put in front."""
        bits = len(self.levels)
        for k, (ones, zeros) in enumerate(self.levels):
            up = ((symbols >> (bits - 1 - k)) & 1).astype(bool)
            before = ones[at]
            at = np.where(up, zeros + before, at - before)
        return self.starts[symbols] + at - self.base[symbols]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern number, low, high) of the patterns (rows of symbols >= 1) that occur."""
        count, length = patterns.shape
        return self.search_at(patterns.ravel(), np.arange(count) * length, length)

    def search_at(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``search`` for the runs of ``length`` symbols (>= 1) that begin at ``starts`` of one array."""
        which = np.arange(len(starts))
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), self.n, np.int64)
        for j in reversed(range(length)):
            c = symbols[starts[which] + j]
            low, high = self.step_back(c, low), self.step_back(c, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix-array rows, by walking back to sampled rows."""
        out = np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        at = rows.astype(np.int64)
        walked = 0
        while len(open_):
            hit = self.sampled[at + 1] > self.sampled[at]
            out[open_[hit]] = self.samples[self.sampled[at[hit]]] + walked
            open_, at = open_[~hit], at[~hit]
            if len(open_):
                at = self.step_back(self.last[at], at)
            walked += 1
        return out
