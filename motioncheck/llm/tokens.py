"""Ids of a byte-level BPE vocabulary file, word by word with a cache.

A single space between two characters that aren't white space is a bound that no token
crosses, so a text's ids are those of its space-led words one after another. Words are found
and cached by their hashes, many at once; new ones are encoded together. The vocabulary's
added tokens part a word first and are one id each, as in its own library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from motioncheck.llm.words import BYTE, CHUNK_BYTES, WordTable, distinct, spread, text_buffers, word_hashes

#: Words, and ids, that a worker's cache keeps; a full cache is emptied.
CACHE, CACHE_IDS = 1_000_000, 6_000_000

#: The splitting pattern of this kind of vocabulary, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space of one byte, and the first bytes of longer white space, fixed values.
_white = np.zeros(256, bool)
_white[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_wide = np.zeros(256, bool)
_wide[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def _gaps(raw: np.ndarray) -> np.ndarray:
    """The single spaces between characters that aren't white space."""
    at = np.flatnonzero(raw == 32)
    at = at[(at > 0) & (at < len(raw) - 1)]
    at = at[~_white[raw[at - 1]] & ~_white[raw[at + 1]]]
    # longer white space after the space (by its first byte), or before it (by the character's first byte)
    odd = _wide[raw[at + 1]]
    for back in (2, 3):
        far = np.maximum(at - back, 0)
        odd |= _wide[raw[far]] & (raw[np.minimum(far + 1, len(raw) - 1)] >= 0x80)
    for i in np.flatnonzero(odd):
        p = int(at[i])
        before, after = raw[max(0, p - 4) : p].tobytes().decode("utf-8", "ignore"), raw[p + 1 : p + 5].tobytes().decode("utf-8", "ignore")
        odd[i] = before[-1:].isspace() or after[:1].isspace()
    return at[~odd]


class Words:
    """A vocabulary, and the ids of words that were met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        step = made.get("pre_tokenizer") or {}
        plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not made.get("normalizer")
        # an added token that takes in white space, or only stands between certain characters, is left to the library
        tokens = made.get("added_tokens") or []
        plain &= not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or not x["content"] or any(c.isspace() for c in x["content"]) for x in tokens)
        # ids in the order of merges: ranks are enough, and the vocabulary's faster library does
        self.core = None
        if plain and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(pairs)):
            import tiktoken

            byte = _byte_of()
            self.added = {x["content"]: x["id"] for x in tokens}
            ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in self.added}
            self.core = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
            self.width = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, np.int64)
            for word, i in [*ranks.items(), *((x.encode(), i) for x, i in self.added.items())]:
                self.width[i] = len(word)
            self.rows = WordTable(CACHE)
            self.start, self.count = np.zeros(CACHE, np.int32), np.zeros(CACHE, np.int32)
            self.ids, self.used = np.zeros(CACHE_IDS, np.uint32), 0
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    def _ids(self, text: str) -> np.ndarray:
        if any(x in text for x in self.added):
            return np.array(self.core.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.core.encode_ordinary(text), np.uint32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has. Space-led words that end in no white space are encoded together."""
        plain = [w[:1] == b" " and not w[-1:].isspace() and w[-1] < 0x80 or w[:1] == b" " and not w.decode()[-1:].isspace() for w in words]
        led = [w for w, p in zip(words, plain) if p]
        ids = self._ids(b"".join(led).decode())
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(w) for w in led])) + 1 if led else np.zeros(0, np.int64)
        parts, counts, done, n = [], np.zeros(len(words), np.int64), 0, 0
        for i, (w, p) in enumerate(zip(words, plain)):
            if p:
                counts[i] = ends[n] - (ends[n - 1] if n else 0)
                n += 1
            else:
                own = self._ids(w.decode())
                last = int(ends[n - 1]) if n else 0
                parts += [ids[done:last], own]
                done, counts[i] = last, len(own)
        return np.concatenate([*parts, ids[done:]]), counts

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if not self.core:
            for e in self.slow.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)
            return
        raw, at = text_buffers(texts)
        row = 0
        while row < len(at) - 1:
            to = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1)
            yield from self._chunk(raw[at[row] : at[to]], at[row : to + 1] - at[row])
            row = to

    def _chunk(self, raw: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        if not len(raw):
            yield from (np.zeros(0, np.uint32) for _ in bounds[1:])
            return
        begins = distinct(np.concatenate([_gaps(raw), bounds[:-1][bounds[:-1] < bounds[1:]]]))
        ends = np.append(begins[1:], len(raw))
        hashes = word_hashes(raw, begins, ends, BYTE)
        at = self.rows.find(hashes)
        missing = np.flatnonzero(at < 0)
        new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
        text = raw.tobytes()
        ids, counts = self._encode([text[begins[i] : ends[i]] for i in missing[first].tolist()]) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        # known words' ids are in the store, new ones' beside it
        start, count = self.start[at].astype(np.int64), self.count[at].astype(np.int64)
        new_at = np.cumsum(counts) - counts
        start[missing], count[missing] = new_at[back] + len(self.ids), counts[back]
        where = spread(start, count)
        fresh = where >= len(self.ids)
        found = self.ids[np.where(fresh, 0, where)]
        found[fresh] = ids[where[fresh] - len(self.ids)]
        if self.rows.size + len(new) > CACHE or self.used + len(ids) > CACHE_IDS:
            self.rows.clear()
            self.used = 0
        if len(new) <= CACHE and len(ids) <= CACHE_IDS:
            span = slice(self.rows.size, self.rows.size + len(new))
            self.start[span], self.count[span] = self.used + new_at, counts
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.rows.add(new)
        cuts = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begins, bounds)]
        yield from (found[a:b] for a, b in zip(cuts[:-1], cuts[1:]))


_held: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """This worker's words of a vocabulary."""
    if path not in _held:
        _held[path] = Words(path)
    return _held[path]
