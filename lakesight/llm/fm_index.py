"""An FM-index over word numbers: suffix order, wavelet ranks, backward search and sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of ``s``, whose last symbol is smaller than all others and occurs once.

    The first sort takes as many symbols as fit 62 bits; then prefix doubling
    sorts only the suffixes that are still tied.
    """
    n, bits = len(s), max(1, int(s.max()).bit_length())
    depth = min(n, max(1, 62 // bits))
    key = np.zeros(n, dtype=np.int64)
    for i in range(depth):
        key <<= bits
        key[: n - i] |= s[i:]
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    place = np.arange(n)
    start = np.maximum.accumulate(np.where(first, place, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    tied = np.flatnonzero(~first | ~np.concatenate([first[1:], [True]]))
    while len(tied):
        suffixes = order[tied]
        pair = rank[suffixes] << 32 | rank[np.minimum(suffixes + depth, n - 1)]
        by = np.argsort(pair)
        suffixes, pair = suffixes[by], pair[by]
        order[tied] = suffixes
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[suffixes] = np.maximum.accumulate(np.where(first, tied, 0))
        tied = tied[~first | ~np.concatenate([first[1:], [True]])]
        depth *= 2
    return order


class WaveletMatrix:
    """Counts of a symbol before a position, bit by bit, for whole arrays of questions."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(s) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), dtype=np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zero = s[~bit]
            self.levels.append((level, words, before, len(zero)))
            s = np.concatenate([zero, s[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low = np.zeros_like(at)
        for level, words, before, zeros in self.levels:
            one = (symbols >> level & 1).astype(bool)
            ones, base = self._ones(words, before, at), self._ones(words, before, low)
            at = np.where(one, zeros + ones, at - ones)
            low = np.where(one, zeros + base, low - base)
        return at - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for level, words, before, zeros in self.levels:
            one = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones, base = self._ones(words, before, at), self._ones(words, before, low)
            at = np.where(one, zeros + ones, at - ones)
            low = np.where(one, zeros + base, low - base)
            symbol |= one.astype(at.dtype) << level
        return symbol, at - low


class FmIndex:
    """Index of a text of symbols > 0; 0 is added as its end."""

    def __init__(self, text: np.ndarray, sample: int = 4):
        s = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(s)
        self.size, self.sample = len(s), sample
        self.symbols = int(s.max()) + 1
        self.before = np.zeros(self.symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(s, minlength=self.symbols), out=self.before[1:])
        self.ranks = WaveletMatrix(s[order - 1], max(1, int(self.symbols - 1).bit_length()))
        self.sampled = order % sample == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffix order per pattern.

        ``patterns`` are right-aligned rows of symbols; a symbol outside 1..symbols-1 is not in the text.
        """
        count, width = patterns.shape
        low, high = np.zeros(count, dtype=np.int64), np.full(count, self.size, dtype=np.int64)
        alive = np.flatnonzero(lengths > 0)
        for step in range(width):
            alive = alive[(high > low)[alive]]
            todo = alive[lengths[alive] > step]
            if not len(todo):
                break
            symbol = patterns[todo, width - 1 - step]
            known = (symbol > 0) & (symbol < self.symbols)
            high[todo[~known]] = low[todo[~known]]
            todo, symbol = todo[known], symbol[known]
            if step == 0:
                low[todo], high[todo] = self.before[symbol], self.before[symbol + 1]
                continue
            both = self.ranks.rank(np.concatenate([symbol, symbol]), np.concatenate([low[todo], high[todo]]))
            low[todo] = self.before[symbol] + both[: len(todo)]
            high[todo] = self.before[symbol] + both[len(todo) :]
        low[lengths <= 0] = high[lengths <= 0] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order: walk left until a sampled position."""
        out, steps = np.empty(len(rows), dtype=np.int64), 0
        index, rows = np.arange(len(rows)), rows.copy()
        while len(index):
            hit = self.sampled[rows]
            out[index[hit]] = self.positions[self.sampled_before[rows[hit]]] + steps
            index, rows = index[~hit], rows[~hit]
            symbol, rank = self.ranks.symbol_and_rank(rows)
            rows = self.before[symbol] + rank
            steps += 1
        return out
