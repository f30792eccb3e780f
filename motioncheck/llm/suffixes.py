"""Stretches of words that are dealt by a minimizer, suffix arrays of them, and the long substrings that distinct owners share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from motioncheck.llm import words


def pack_stretches(least: np.ndarray, bits: int, hashes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows of (bucket, block): stretches of hashed words, by the top bits of their minimizer, with two 64-bit values and a place."""
    bucket = (least >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    blocks = []
    for a, b in zip(cuts, cuts[1:]):
        own = order[a:b]
        text = hashes[words.spread(begins[own], lengths[own])]
        # 48 bits of a word's hash
        blocks.append(b"".join([np.uint32(b - a).tobytes(), ids[own].tobytes(), keys[own].tobytes(), places[own].astype(np.uint32).tobytes(), lengths[own].astype(np.uint32).tobytes(), (text >> np.uint64(32)).astype(np.uint32).tobytes(), ((text >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()]))
    return pa.record_batch([pa.array(bucket[order[cuts[:-1]]]), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def unpack_stretches(blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    """(ids, keys, places, lengths, words) of blocks made by pack_stretches()."""
    parts: list[tuple] = []
    for x in blocks:
        n, at, own = int(np.frombuffer(x, np.uint32, 1)[0]), 4, []
        for kind in (np.int64, np.int64, np.uint32, np.uint32):
            own.append(np.frombuffer(x, kind, n, at))
            at += n * np.dtype(kind).itemsize
        total = int(own[3].sum())
        high, low = np.frombuffer(x, np.uint32, total, at), np.frombuffer(x, np.uint16, total, at + 4 * total)
        parts.append((*own, high.astype(np.uint64) << np.uint64(16) | low))
    return tuple(np.concatenate(p) for p in zip(*parts))


#: Odd multipliers of two independent digests.
FIRST, SECOND = 0xD1342543DE82EF95, 0x9FB21C651E98DF25


def digests(text: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, multiplier: int = FIRST) -> np.ndarray:
    """A hash of each stretch's words."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(text) * words.powers(np.uint64(multiplier), len(text)))])
    inverse = words.powers(np.uint64(pow(multiplier, -1, 1 << 64)), len(text) + 1)
    return words.mix((sums[firsts + lengths] - sums[firsts]) * inverse[firsts] + lengths.astype(np.uint64))


def distinct_kinds(kind: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each kind, kinds ascending, and the least low and largest high of the kind."""
    _, one, of = np.unique(kind, return_index=True, return_inverse=True)
    least, most = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(least, of, low)
    np.maximum.at(most, of, high)
    return one, least, most


def distinct_pairs(first: np.ndarray, second: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """distinct_kinds() of kinds that two digests tell apart, ascending by the first, then the second."""
    if not len(first):
        return np.zeros(0, np.int64), low, high
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order[cuts], np.minimum.reduceat(low[order], cuts), np.maximum.reduceat(high[order], cuts)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffixes in order, by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width, order = 1, np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        if width < n:
            second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        width *= 2
    return order


def repeated_starts(text: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
    """Where in some streams (one after another) a substring of `least` symbols begins that two owners have.

    low and high: the least and the largest owner of each stream. The suffix array of the streams,
    each followed by a symbol of its own, has equal substrings side by side.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(text)) + of  # in the streams with separators
    symbols = np.full(len(text) + len(lengths), -1, np.int64)
    symbols[at] = np.unique(text, return_inverse=True)[1]
    gaps = np.flatnonzero(symbols < 0)
    symbols[gaps] = -1 - np.arange(len(gaps))
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    order = suffix_array(symbols)
    # suffixes side by side that agree in `least` symbols; one past the end agrees with none
    padded = np.concatenate([symbols, np.full(least, -1 - len(gaps))])
    alike = np.ones(len(order) - 1, bool)
    for j in range(least):
        alike &= padded[order[1:] + j] == padded[order[:-1] + j]
    edges = np.flatnonzero(np.concatenate([[True], ~alike]))
    several = np.minimum.reduceat(low[owner[order]], edges) != np.maximum.reduceat(high[owner[order]], edges)
    run = np.cumsum(np.concatenate([[False], ~alike]))
    found = order[several[run]]
    # a suffix that is shorter than `least` before its separator stands alone, but its stream may have two owners
    found = found[(symbols[found] >= 0) & (found + least <= ends[owner[found]] + owner[found])]
    return np.sort(found - owner[found])


def repeated_tokens(streams: list[list], least: int, owners: list[int]) -> list[np.ndarray]:
    """For each stream, which of its tokens a substring of `least` tokens or more covers that another owner's stream has too."""
    tokens: dict = {}
    symbols = np.array([tokens.setdefault(t, len(tokens)) for stream in streams for t in stream], np.int64)
    lengths = np.array([len(stream) for stream in streams], np.int64)
    own = np.array(owners, np.int64)
    cover = np.zeros(len(symbols) + 1, np.int64)
    at = repeated_starts(symbols, lengths, own, own, least)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + least, -1)
    found = np.cumsum(cover[:-1]) > 0
    cuts = np.cumsum(np.concatenate([[0], lengths]))
    return [found[a:b] for a, b in zip(cuts, cuts[1:])]
