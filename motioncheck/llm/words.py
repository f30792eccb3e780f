"""Vectorised words and shingles of a batch of texts.

Texts stay in their Arrow buffers: word bounds, word hashes and shingle hashes of a
chunk of documents come from a few numpy passes over the bytes, with no Python object
for a word. A chunk holds about ``CHUNK_BYTES`` of text, or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: White space is space and the bytes 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random value for each byte; one table also lower-cases A-Z.
BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]

_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, _U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


@dataclass
class Chunk:
    """Words of some documents of a batch. first[d]:first[d + 1] are those of document d."""

    row: int
    docs: int
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, lower: bool = False, white: np.ndarray = WHITE) -> Iterator[Chunk]:
    """The rows of a string column in order, a chunk at a time."""
    raw, at = text_buffers(column)
    table = BYTE_LOWER if lower else BYTE
    row = 0
    while row < len(at) - 1:
        to = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1)
        own, bounds = raw[at[row] : at[to]], at[row : to + 1] - at[row]
        starts, ends = word_bounds(own, bounds, white)
        yield Chunk(row, to - row, own, starts, ends, np.searchsorted(starts, bounds), word_hashes(own, starts, ends, table))
        row = to


def word_bounds(raw: np.ndarray, bounds: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = white[raw]
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = gap[:-1]
    begins[bounds[:-1][bounds[:-1] < n]] = True
    begins &= ~gap
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    last &= ~gap
    return np.flatnonzero(begins), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    sums = np.empty(len(raw) + 1, _U)
    sums[0] = 0
    np.cumsum(table[raw] * powers(_BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(raw) + 1)[starts])


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, at the first one's index; across document bounds too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out)


def sequence_digests(chunk: Chunk) -> np.ndarray:
    """A hash of each document's whole word sequence."""
    n = len(chunk.hashes)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum(chunk.hashes * powers(_STEP, n), out=sums[1:])
    a, b = chunk.first[:-1], chunk.first[1:]
    return mix((sums[b] - sums[a]) * powers(_U(pow(int(_STEP), -1, 1 << 64)), n + 1)[a] + (b - a).astype(_U))


def shingle_sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, ascending: hashes, and the first index of each document.

    Fewer than k words make one shingle; no words make none.
    """
    counts = chunk.counts
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(first[-1], _U)
    grams = ngrams(chunk.hashes, k)
    keep = np.zeros(len(out), bool)
    for d in range(chunk.docs):
        a, b, w, n = first[d], first[d + 1], chunk.first[d], counts[d]
        if n >= k:
            own = out[a:b]
            own[:] = grams[w : w + b - a]
            own.sort()
            keep[a] = True
            np.not_equal(own[1:], own[:-1], out=keep[a + 1 : b])
        elif n:
            out[a] = ngrams(chunk.hashes[w : w + n], int(n))[0] ^ _U(int(n) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
            keep[a] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def minimizers(chunk: Chunk, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of each whole window's first word, and the window's minimizer: the least hash of `gram` words in a row."""
    grams = ngrams(chunk.hashes, gram)
    n = len(chunk.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for j in range(1, width - gram + 1):
        np.minimum(least, grams[j : j + n], out=least)
    left = np.repeat(chunk.first[1:], chunk.counts)[:n] - np.arange(n)
    whole = np.flatnonzero(left >= width)
    return whole, least[whole]


def runs(starts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where a run of consecutive windows with one minimizer begins."""
    return np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else starts


class WordTable:
    """Rows for up to `most` word hashes, in open addressing; found for many hashes at once."""

    PROBES = 24

    def __init__(self, most: int = 500_000):
        self.most = most
        self.mask = np.uint64((1 << (2 * most - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, _U)
        self.rows = np.zeros(int(self.mask) + 1, np.int32)
        self.size = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's row, or -1."""
        hashes = np.maximum(hashes, _U(1))
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes & self.mask).astype(np.int64)
        have = self.keys[slot]
        hit = have == hashes
        out[hit] = self.rows[slot[hit]]
        todo = np.flatnonzero(~hit & (have != 0))
        for step in range(1, self.PROBES):
            if not len(todo):
                break
            at = (slot[todo] + step) & int(self.mask)
            have = self.keys[at]
            hit = have == hashes[todo]
            out[todo[hit]] = self.rows[at[hit]]
            todo = todo[~hit & (have != 0)]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Gives distinct new hashes the next rows. One that finds no place stays unknown, and its row unused."""
        hashes = np.maximum(hashes, _U(1))
        rows = np.arange(self.size, self.size + len(hashes), dtype=np.int32)
        self.size += len(hashes)
        slot = (hashes & self.mask).astype(np.int64)
        todo = np.arange(len(hashes))
        for step in range(self.PROBES):
            at = (slot[todo] + step) & int(self.mask)
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[todo[free]]  # of several for one place, the last gets it
            placed = self.keys[at] == hashes[todo]
            self.rows[at[placed]] = rows[todo[placed]]
            todo = todo[~placed]
            if not len(todo):
                return


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of several ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by sorting."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
