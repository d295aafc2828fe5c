"""An FM-index over sequences of small whole numbers: backward search by wavelet ranks, positions by sampled suffixes."""

from __future__ import annotations

import numpy as np

from . import words as W


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling. 0 ends a run; ends are unlike each other, ordered by place. The last symbol is 0."""
    n = len(symbols)
    count = np.bincount(symbols)
    rank = (np.cumsum(count) - count)[symbols]
    zeros = np.flatnonzero(symbols == 0)
    rank[zeros] = np.arange(len(zeros))
    live = np.flatnonzero((symbols > 0) & (count[symbols] > 1))
    step = 1
    while len(live):
        key = rank[live] * np.int64(n) + rank[live + step]
        order = np.argsort(key, kind="stable")
        key, live = key[order], live[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        base = rank[live]
        outer = np.r_[True, base[1:] != base[:-1]]
        at = np.arange(len(live))
        begin = np.maximum.accumulate(np.where(fresh, at, 0))
        moved = base + begin - np.maximum.accumulate(np.where(outer, at, 0))
        rank[live] = moved
        live = live[~fresh | np.r_[~fresh[1:], False]]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FmIndex:
    """symbols: runs of numbers above 0, each ended by a 0. Positions are kept for every sample-th suffix and for run starts."""

    def __init__(self, symbols: np.ndarray, sample: int = 16) -> None:
        self.n = len(symbols)
        order = sorted_suffixes(symbols)
        self.last = symbols[order - 1]  # of the suffix at 0 it is the final 0
        count = np.bincount(symbols, minlength=2)
        self.before = np.cumsum(count) - count
        self.bits = max(1, int(len(count) - 1).bit_length())
        kept = (order % sample == 0) | (self.last == 0)
        self.kept, self.rank_kept, self.places = kept, np.cumsum(kept) - kept, order[kept]
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        rest = self.last
        for k in range(self.bits - 1, -1, -1):
            bit = (rest >> k) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first upto last symbols."""
        low, high = np.zeros_like(upto), upto
        for k, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            set_ = ((symbol >> k) & 1).astype(bool)
            low_1, high_1 = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low = np.where(set_, zeros + low_1, low - low_1)
            high = np.where(set_, zeros + high_1, high - high_1)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: a row each, of equal lengths. Gives the bounds of their suffixes."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.flatnonzero((patterns < len(self.before)).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live] = self.before[c] + self.rank(c, low[live])
            high[live] = self.before[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walks back to the nearest one that is kept."""
        out = np.full(len(rows), -1, np.int64)
        walking, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(walking):
            there = self.kept[rows]
            out[walking[there]] = self.places[self.rank_kept[rows[there]]] + steps
            walking, rows = walking[~there], rows[~there]
            c = self.last[rows]
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


def index_runs(symbols: np.ndarray, starts_text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers with a 0 after each run, the place in symbols of each) of runs of numbers above 0 within a text, of that length or more."""
    held = symbols > 0
    begin = held.copy()
    begin[1:] &= ~held[:-1] | starts_text[1:]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.flatnonzero(held & np.r_[~held[1:] | starts_text[1:], True]) + 1
    at, stop = at[stop - at >= least], stop[stop - at >= least]
    size = stop - at
    place = W.ranges(at, size + 1)
    out = np.r_[symbols, 0][place]
    out[np.cumsum(size + 1) - 1] = 0
    return out, place
