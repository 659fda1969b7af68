"""FM-index over a shard of word symbols: suffix order, wavelet ranks in blocks, backward search, sampled positions.

Symbol 0 stands for any run of words that no test phrase has, and for the ends of texts. Suffixes are compared up to their first
0 and then by place; backward steps over symbols other than 0 stay right under that order, and no test phrase has a 0.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes sorted by the symbols up to their first 0, ties by place: one packed key, then doubling on what is still equal."""
    n = len(symbols)
    k = max(1, 62 // bits)
    k = 1 << (min(k, 8).bit_length() - 1)
    zero = np.flatnonzero(symbols == 0)
    run = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(k):
        shifted = np.zeros(n, np.int64)
        shifted[: n - j] = symbols[j:]
        shifted[run < j] = 0
        key = key << bits | shifted
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    h = k
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = first
        alone = new.copy()
        alone[:-1] &= new[1:]
        rows = np.flatnonzero(~alone & (run[order] >= h))
        if not rows.size:
            return order
        at = order[rows]
        follow = rank[at + h]
        sort = np.lexsort((at, follow, rank[at]))
        order[rows] = at[sort]
        changed = np.ones(len(rows), bool)
        changed[1:] = (rank[at][sort][1:] != rank[at][sort][:-1]) | (follow[sort][1:] != follow[sort][:-1])
        new[rows] = changed
        h *= 2


class Bits:
    """Bit vector with counts at every 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before `at`."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Index of one shard; `symbols` ends with 0."""

    def __init__(self, symbols: np.ndarray, bits: int):
        order = suffix_order(symbols, bits)
        self.n, self.bits = len(symbols), bits
        last = symbols[order - 1]
        self.last = last
        counts = np.bincount(symbols, minlength=(1 << bits) + 1)
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[Bits, int]] = []
        current = last
        for level in range(bits - 1, -1, -1):
            ones = (current >> level & 1).astype(bool)
            self.levels.append((Bits(ones), int(len(ones) - ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])
        # every 16th place, and the first place of each run, which no step over a 0 can leave
        kept = (order % SAMPLE == 0) | (last == 0)
        self.marks, self.places = Bits(kept), order[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands in the last column before row `at`; by descent through the wavelet levels."""
        low, high = np.zeros_like(at), at
        for depth, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - depth) & 1).astype(bool)
            ones_low, ones_high = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + ones_low, low - ones_low)
            high = np.where(one, zeros + ones_high, high - ones_high)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (m, k), by backward search of all at once."""
        m, k = phrases.shape
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(k - 1, -1, -1):
            symbol = phrases[live, j]
            low[live] = self.begin[symbol] + self.rank(symbol, low[live])
            high[live] = self.begin[symbol] + self.rank(symbol, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffix rows: steps back to a sampled place."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while live.size:
            at = rows[live]
            sampled = self.marks.rank(at + 1) > self.marks.rank(at)
            done = live[sampled]
            out[done] = self.places[self.marks.rank(rows[done])] + steps[done]
            live = live[~sampled]
            symbol = self.last[rows[live]]
            rows[live] = self.begin[symbol] + self.rank(symbol, rows[live])
            steps[live] += 1
        return out
