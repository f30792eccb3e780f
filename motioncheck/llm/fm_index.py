"""A compressed full-text index of word sequences: BWT in a wavelet matrix, searched backwards.

All searches run for an array of patterns at once.
"""

from __future__ import annotations

import numpy as np

from motioncheck.llm.words import distinct, ngrams

#: The index is sorted by this many words; patterns have that many at most.
DEPTH = 16
#: Words of a pattern's end that a table finds in one step.
TAIL = 8


class Bits:
    """A bit vector of packed words with a running count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int64)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """rank() of symbols below 2**levels in a sequence."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels: list[Bits] = []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1 > 0
            self.levels.append(Bits(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbols: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before `at`, and before `ends`."""
        base = np.zeros_like(at)
        last = len(self.levels) - 1
        for i, bits in enumerate(self.levels):
            one = (symbols >> (last - i)) & 1 > 0
            low, high, start = bits.ones(at), bits.ones(ends), bits.ones(base)
            at = np.where(one, bits.zeros + low, at - low)
            ends = np.where(one, bits.zeros + high, ends - high)
            base = np.where(one, bits.zeros + start, base - start)
        return at - base, ends - base


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Positions of symbols by their next DEPTH symbols (by prefix doubling)."""
    n, rank, width = len(symbols), symbols.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        if width < n:
            second[: n - width] = rank[width:] + 1
        key = rank * np.int64(n + int(symbols.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        if width * 2 >= DEPTH:
            return order
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, width = new, width * 2


class FMIndex:
    """The index of a shard's text: sequences of 64-bit word hashes, one after another.

    places: for each word, the number that minimum() reports of the sequence at that word.
    """

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, values: np.ndarray):
        self.words = distinct(hashes)
        ends = np.cumsum(lengths)
        # symbol 0 ends each sequence
        symbols = np.insert(np.searchsorted(self.words, hashes) + 1, ends, 0)
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        order = sorted_suffixes(symbols)
        self.values = values[owner][order]
        self.levels = max(1, int(len(self.words)).bit_length())
        self.matrix = WaveletMatrix(symbols[order - 1], self.levels)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.words) + 1))])
        self._tails(hashes, symbols, order, ends)

    def _tails(self, hashes: np.ndarray, symbols: np.ndarray, order: np.ndarray, ends: np.ndarray) -> None:
        grams = ngrams(np.insert(hashes, ends, np.uint64(0)), TAIL)
        gaps = np.cumsum(symbols == 0)
        whole = np.zeros(len(symbols), bool)
        whole[: len(grams)] = gaps[TAIL - 1 :] == np.concatenate([[0], gaps[: len(grams) - 1]]) if len(grams) else False
        at = np.flatnonzero(whole[order])
        own = grams[order[at]]
        new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        by = np.argsort(own[first])
        self.tails, self.tail_from = own[first][by], at[first][by]
        self.tail_to = self.tail_from + np.diff(np.append(first, len(own)))[by]

    def intervals(self, hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each start, the suffixes that begin with hashes[start:start + width]: from, to; equal if there are none."""
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.tails) or not len(starts):
            return low, high
        tail = ngrams(hashes, TAIL)[starts + width - TAIL]
        at = np.minimum(np.searchsorted(self.tails, tail), len(self.tails) - 1)
        live = np.flatnonzero(self.tails[at] == tail)
        begin, end = self.tail_from[at[live]], self.tail_to[at[live]]
        for back in range(width - TAIL - 1, -1, -1):  # a word to the left at a time
            word = hashes[starts[live] + back]
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            known = self.words[at] == word
            live, symbol, begin, end = live[known], at[known] + 1, begin[known], end[known]
            begin, end = self.matrix.rank(symbol, begin, end)
            begin, end = begin + self.below[symbol], end + self.below[symbol]
            some = begin < end
            live, begin, end = live[some], begin[some], end[some]
        low[live], high[live] = begin, end
        return low, high

    def minimum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of each interval of one width; the largest integer for empty ones."""
        out = np.full(len(low), np.iinfo(np.int64).max)
        some = np.flatnonzero(low < high)
        if len(some):
            begin, back = np.unique(low[some], return_inverse=True)
            end = np.empty_like(begin)
            end[back] = high[some]
            out[some] = np.minimum.reduceat(np.append(self.values, 0), np.stack([begin, end], 1).ravel())[::2][back]
        return out
