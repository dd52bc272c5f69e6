"""A word-level FM-index of one training shard: suffix order, Burrows-Wheeler transform, wavelet matrix, sampled places."""

from __future__ import annotations

import numpy as np

#: Every place at this distance from its run's start keeps its position, so a walk takes fewer steps.
SAMPLE_EVERY = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of `symbols` by their suffixes; a suffix ends at its first 0, and zeros differ by their place.

    Prefix doubling: three symbols at once first, then only suffixes that still tie with another are sorted again.
    """
    n = len(symbols)
    zeros = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    padded = np.concatenate([rank, np.zeros(2, np.int64)])
    base = np.int64(rank.max() + 1)
    if int(base) ** 3 < 2**62:
        key, depth = (padded[:n] * base + padded[1:n + 1]) * base + padded[2:n + 2], 3
    else:
        key, depth = padded[:n] * base + padded[1:n + 1], 2
    order = np.argsort(key, kind="stable")
    at, values = np.arange(n), key[order]
    while True:
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = at[~alone]
        if not len(at):
            return order
        rows = order[at]
        behind = rows + depth
        key = rank[rows] * np.int64(n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        inner = np.argsort(key, kind="stable")
        order[at], values = rows[inner], key[inner]
        depth *= 2


class FMIndex:
    """Index of runs of symbols from 1 up; each run ends with a 0."""

    def __init__(self, symbols: np.ndarray) -> None:
        order = suffix_order(symbols)
        before = np.where(order > 0, symbols[order - 1], 0)
        self.size = len(symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols))]).astype(np.int64)
        ends = np.flatnonzero(symbols == 0)
        begins = np.concatenate([[0], ends[:-1] + 1])
        within = np.arange(self.size) - np.repeat(begins, ends - begins + 1)
        kept = (within % SAMPLE_EVERY == 0)[order]
        self.sample_rank = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]
        # Wavelet matrix: one level per bit, from the highest; zeros of a level go before its ones.
        self.levels: list[tuple[np.ndarray, int, int]] = []
        current = before
        for bit in reversed(range(max(1, int(symbols.max()).bit_length()))):
            ones = (current >> bit) & 1
            counts = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((counts, self.size - int(counts[-1]), bit))
            current = np.concatenate([current[ones == 0], current[ones == 1]])

    def ranks(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol in the transform before each of the places."""
        begin, found = np.zeros(len(symbol), np.int64), list(places)
        for counts, zeros, bit in self.levels:
            one = (symbol >> bit) & 1 == 1
            begin, *found = (np.where(one, zeros + (c := counts[x]), x - c) for x in (begin, *found))
        return [x - begin for x in found]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the index that begin with each pattern (of one length): backward search, the last symbol first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.flatnonzero((patterns < len(self.below) - 1).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[live, k]
            a, b = self.ranks(symbol, low[live], high[live])
            low[live], high[live] = self.below[symbol] + a, self.below[symbol] + b
            live = live[b > a]
            if not len(live):
                break
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows: steps back through the transform up to a sampled place."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        walking = np.arange(len(rows))
        while len(walking):
            here = rows[walking]
            known = self.sample_rank[here + 1] > self.sample_rank[here]
            done = walking[known]
            out[done] = self.samples[self.sample_rank[here[known]]] + steps[done]
            walking, here = walking[~known], here[~known]
            begin, symbol = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
            for counts, zeros, bit in self.levels:
                c = counts[here]
                one = counts[here + 1] > c
                symbol |= one.astype(np.int64) << bit
                begin, here = np.where(one, zeros + counts[begin], begin - counts[begin]), np.where(one, zeros + c, here - c)
            rows[walking] = self.below[symbol] + here - begin
            steps[walking] += 1
        return out
