"""FM-index over the words of a shard: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence, level by level (the matrix form of the tree)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        rest = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(at), at
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbols >> level) & 1 == 1
            ones = self.ones[i]
            low, high = np.where(bit, self.zeros[i] + ones[low], low - ones[low]), np.where(bit, self.zeros[i] + ones[high], high - ones[high])
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position, and its rank there."""
        symbols, low, high = np.zeros_like(at), np.zeros_like(at), at
        for i in range(self.levels):
            ones = self.ones[i]
            bit = ones[high + 1] - ones[high] == 1
            symbols = symbols << 1 | bit
            low, high = np.where(bit, self.zeros[i] + ones[low], low - ones[low]), np.where(bit, self.zeros[i] + ones[high], high - ones[high])
        return symbols, high - low


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Start of each suffix in sorted order, by doubling; after the first sort only tied suffixes are sorted again."""
    n = len(text)
    known = 4 if 4 * int(sigma).bit_length() < 63 else 1
    key = text.astype(np.int64)
    padded = np.concatenate([key, np.full(3, -1)]) + 1
    for i in range(1, known):
        key = key * (sigma + 1) + padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while True:
        tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
        if not len(tied):
            return order
        part = order[tied]
        key = rank[part] * np.int64(n + 1) + rank[np.minimum(part + known, n)] + 1
        resorted = np.argsort(key, kind="stable")
        order[tied] = part = part[resorted]
        ordered = key[resorted]
        head[tied] = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank[part] = tied[np.flatnonzero(head[tied])[np.cumsum(head[tied]) - 1]]
        known *= 2


class FMIndex:
    """Index of a sequence of symbols (1..sigma-1; 0 separates texts).

    Every `sample`-th text position is kept; others are found by stepping back to one. The
    sequence ends with a symbol of its own, below the separators: with one more separator
    there, steps back over separators would lead to a wrong text. So symbols count from 1 here.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8):
        text = np.concatenate([symbols + 1, [0]]).astype(np.int64)
        n, sigma = len(text), sigma + 1
        order = suffix_order(text, sigma)
        self.sigma, self.n = sigma, n
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.sampled = order % sample == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases (rows of equal length), all searched at once."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column] + 1
            low, high = self.before[symbol] + self.tree.rank(symbol, low), self.before[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by stepping back to the nearest sampled one."""
        found, at, steps = np.full(len(rows), -1, dtype=np.int64), rows.astype(np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            hit = self.sampled[here]
            found[open_[hit]] = self.samples[self.sample_rank[here[hit]]] + steps
            open_ = open_[~hit]
            symbols, rank = self.tree.access(at[open_])
            at[open_] = self.before[symbols] + rank
            steps += 1
        return found
