"""A compressed FM-index over integer sequences, with backward search of many patterns in step.

The Burrows-Wheeler transform is held as a wavelet matrix of packed bits with a running count per 64 of them. Suffixes are sorted by their
first 2 ** ``doublings`` symbols, which makes backward search exact for patterns up to that length.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, doublings: int = 7) -> np.ndarray:
    """Starts of the cyclic suffixes in order of their first 2 ** doublings symbols, by prefix doubling."""
    n = len(symbols)
    rank, order, width = symbols.astype(np.int64), None, 1
    for _ in range(doublings):
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        dense = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        rank = np.empty(n, np.int64)
        rank[order] = dense
        width *= 2
        if dense[-1] == n - 1:
            break
    return order


class WaveletMatrix:
    """Rank of any symbol before any position."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.levels = max(1, int(kinds - 1).bit_length())
        n, now = len(symbols), symbols.astype(np.int64)
        words = n // 64 + 1
        self.bits = np.zeros((self.levels, words), np.uint64)
        self.counts = np.zeros((self.levels, words), np.int64)
        self.zeros = np.zeros(self.levels, np.int64)
        for level in range(self.levels):
            bit = (now >> (self.levels - 1 - level) & 1).astype(bool)
            padded = np.zeros(words * 64, bool)
            padded[:n] = bit
            self.bits[level] = np.packbits(padded, bitorder="little").view(np.uint64)
            np.cumsum(np.bitwise_count(self.bits[level])[:-1], out=self.counts[level, 1:])
            self.zeros[level] = n - int(bit.sum())
            now = np.concatenate([now[~bit], now[bit]])
        self.base = np.zeros(kinds, np.int64)
        self.base = self.rank(np.arange(kinds), np.zeros(kinds, np.int64))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        base = self.base[symbols]
        for level in range(self.levels):
            word = at >> 6
            mask = (one << (at & 63).astype(np.uint64)) - one
            ones = self.counts[level][word] + np.bitwise_count(self.bits[level][word] & mask)
            at = np.where(symbols >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at - base


class FMIndex:
    """symbols: texts one after another, each followed by symbol 0, which no text has. owner: a number for each position; a search asks for
    occurrences whose owner is below a bound.
    """

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, doublings: int = 7):
        self.symbols, self.n, self.longest = symbols, len(symbols), 1 << doublings
        kinds = int(symbols.max()) + 1
        order = suffix_order(symbols, doublings)
        self.bwt = WaveletMatrix(symbols[order - 1], kinds)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])
        levels = [owner[order].astype(np.int32)]
        while 2 << (len(levels) - 1) <= self.n:  # range minima of owners by powers of two
            half = 1 << (len(levels) - 1)
            last = levels[-1]
            longer = last.copy()
            longer[: self.n - half] = np.minimum(last[: self.n - half], last[half:])
            levels.append(longer)
        self.least = np.stack(levels)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns with one more symbol in front."""
        both = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        first = self.before[symbols]
        return first + both[: len(low)], first + both[len(low) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner within intervals that are not empty."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.least[k, low], self.least[k, high - (1 << k)])

    def matching_statistics(self, patterns: list[np.ndarray], bound: np.ndarray) -> list[np.ndarray]:
        """For each symbol of each pattern, the length of the longest match that ends there with an owner below bound[q], up to 2 ** doublings
        symbols.

        All of a pattern's ends are searched backwards in step. Symbols that the index does not have match nothing.
        """
        ends = np.cumsum([0, *map(len, patterns)])
        every = np.concatenate([np.zeros(0, np.int64), *patterns])
        query = np.repeat(np.arange(len(patterns)), np.diff(ends))
        lengths, live, at = np.zeros(len(every), np.int64), np.arange(len(every)), np.arange(len(every))
        low, high = np.zeros(len(every), np.int64), np.full(len(every), self.n)
        for _ in range(self.longest):
            known = (every[at] > 0) & (every[at] < len(self.before) - 1)
            live, at, low, high = live[known], at[known], low[known], high[known]
            low, high = self.extend(every[at], low, high)
            fits = high > low
            fits[fits] = self.least_owner(low[fits], high[fits]) < bound[query[live[fits]]]
            lengths[live[fits]] += 1
            goes_on = fits & (at > ends[query[live]])
            live, at, low, high = live[goes_on], at[goes_on] - 1, low[goes_on], high[goes_on]
            if not len(live):
                break
        return np.split(lengths, ends[1:-1])

    def windows_found(self, first: np.ndarray, last: np.ndarray, bound: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of ``width`` symbols that start at positions first[q] to last[q]: (query, from, to) runs of those that occur with an
        owner below bound[q].

        These are the runs of ends whose matching statistic is ``width`` or more, found without the statistics of all other ends. A search goes backwards from the end of one window of a range. Where T[f..e] has no such occurrence, no window around it has; where
        T[f + 1..e] has one, so have all windows inside. What stays open is searched again, split, until every window is decided.
        """
        query, a, b = np.arange(len(first)), first.astype(np.int64), last.astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = True
        while len(query):
            c = b if whole else (a + b) // 2
            c = np.minimum(c, a + self.longest - width)
            fail = self._backwards(c + width - 1, a, bound[query])
            some = fail < c
            found.append((query[some], fail[some] + 1, c[some]))
            left = np.where(some, fail, c - 1)
            right = np.where(some, c + 1, fail + 1)
            more = [(left >= a, a, left), (right <= b, right, b)]
            query, a, b = (np.concatenate(x) for x in zip(*((query[m], x[m], y[m]) for m, x, y in more)))
            whole = False
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (query, query, query)

    def _backwards(self, end: np.ndarray, stop: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest f in [stop, end] for which T[f..end] has no occurrence below the bound, or stop - 1."""
        fail = stop - 1
        live, at = np.arange(len(end)), end.copy()
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.n)
        while len(live):
            low, high = self.extend(self.symbols[at], low, high)
            fits = high > low
            fits[fits] = self.least_owner(low[fits], high[fits]) < bound[live[fits]]
            fail[live[~fits]] = at[~fits]
            goes_on = fits & (at > stop[live])
            live, at, low, high = live[goes_on], at[goes_on] - 1, low[goes_on], high[goes_on]
        return fail
