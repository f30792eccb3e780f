"""Benchmark decontamination: documents that hold a passage close to a benchmark item.

Method: SimHash of item-sized windows. A window's fingerprint has 64 bits, the signs of the summed
bits of its shingles' hashes, whatever their order. Items are indexed by size; a window as long as
an item (or the whole text, if shorter) is looked up among the items of that size. The index cuts
fingerprints into RADIUS + 1 blocks of bits: two of them within RADIUS bits agree in a block, so
looking up each block finds all items within that radius. What is found is verified by the exact
weighted similarity of the shingle multisets.

Of two windows with a similarity of 0.8 a shingle in nine has no partner, so about ten of 64
bits differ, and more than RADIUS in about one pair of a million; the tests measure it. An index
for such a radius has blocks of two and three bits, which most fingerprints share. So before it, and
without loss, windows are pruned: a window with the similarity has so many shingles of the
benchmark, and those with fewer are never fingerprinted. Few documents have any such window.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.llm import shared, words

WORDS, SIMILAR = 5, 0.8
#: Bits in which fingerprints may differ.
RADIUS = 24
#: Bits of the bitmap of an item's shingles, for each of them: about one other shingle in so many is let through to the exact test.
BITMAP = 64
#: Items that are broadcast together; a larger benchmark takes a pass for each part.
ITEMS, ITEM_BYTES = 200_000, 64 << 20
#: Windows of a text that are fingerprinted at once, whatever its length: 64 bytes each.
STRIP = 1 << 14

#: ASCII punctuation parts words here like white space: passages are often quoted in brackets and marks.
PLAIN = words.WHITE.copy()
PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

#: Pairs of a fingerprint asked and one of the index that are looked at together, about.
PAIRS = 1 << 21


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Word shingles in order; fewer words than a shingle has make one."""
    if 0 < len(hashes) < WORDS:
        return words.ngrams(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return words.ngrams(hashes, WORDS)


def window_fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of `size` shingles in a row."""
    n = len(shingles) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(words.mix(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of 1, 2, 4... bits in a row, put together to `size` of them
    total, have, power, width = None, 0, bits, 1
    while True:
        if size & width:
            part = power[have : have + n]
            total = part.copy() if total is None else total + part
            have += width
        if width * 2 > size:
            break
        power, width = power[:-width] + power[width:], width * 2
    return np.packbits(total > size // 2, axis=1, bitorder="little").view(np.uint64).ravel()


class HammingIndex:
    """Fingerprints by each of radius + 1 blocks of their bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.tables = []
        cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
        for a, b in zip(cuts, cuts[1:]):
            key = self._key(prints, a, b)
            order = np.argsort(key, kind="stable")
            cut = np.searchsorted(key[order], np.arange((1 << (b - a)) + 1)).astype(np.int32)
            self.tables.append((a, b, cut, np.diff(cut) > 0, order))

    @staticmethod
    def _key(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int32)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) of those that agree in a block, for each block."""
        for a, b, cut, some, order in self.tables:
            key = self._key(prints, a, b)
            query = np.flatnonzero(some[key])
            key = key[query]
            count = cut[key + 1] - cut[key]
            yield np.repeat(query, count), order[words.spread(cut[key].astype(np.int64), count.astype(np.int64))]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs of all fingerprints within the radius."""
        n, step = max(1, len(self.prints)), max(1, PAIRS // max(1, len(self.prints)))
        pairs = [np.zeros(0, np.int64)]
        for low in range(0, len(prints), step):
            own, found = prints[low : low + step], [np.zeros(0, np.int64)]
            for query, item in self.candidates(own):
                near = np.bitwise_count(own[query] ^ self.prints[item]) <= self.radius
                found.append((low + query[near]) * n + item[near])
            pairs.append(words.distinct(np.concatenate(found)))
        every = np.concatenate(pairs)
        return every // n, every % n


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: the sum of least counts over the sum of largest ones."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0


def least_shared(width: int, size: int) -> int:
    """Shingles that a window of `width` shares at least with an item of `size`, if it has the similarity; more than `width` if it can't have it."""
    return int(np.ceil(SIMILAR * (width + size) / (1 + SIMILAR) - 1e-9))


class Items:
    """A benchmark's items, an index of their fingerprints for each size, and all their shingles."""

    def __init__(self, rows: list[tuple]):
        self.ids: list[int] = []
        self.counts: list[Counter] = []
        self.sizes: list[int] = []
        prints, owners, every = defaultdict(list), defaultdict(list), [np.zeros(0, np.uint64)]
        texts = pa.array([text for _, text in rows], pa.string())
        for chunk in words.chunks(texts, lower=True, white=PLAIN):
            for d in range(chunk.docs):
                own = shingles_of(chunk.hashes[chunk.first[d] : chunk.first[d + 1]])
                if len(own):
                    prints[len(own)].append(window_fingerprints(own, len(own)))
                    owners[len(own)].append(len(self.ids))
                    every.append(own)
                    self.ids.append(rows[chunk.row + d][0])
                    self.counts.append(Counter(own.tolist()))
                    self.sizes.append(len(own))
        #: size of item -> index, and each print's item
        self.groups = {size: (HammingIndex(np.concatenate(found)), np.array(owners[size])) for size, found in sorted(prints.items())}
        flat = np.concatenate(every)
        order = np.argsort(flat, kind="stable")
        #: all shingles, where each one's owners begin, and the items that have it
        self.shingles, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.owners = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self._shift = np.uint64(64 - max(10, (BITMAP * len(self.shingles)).bit_length()))
        self._marks = np.zeros(1 << (64 - int(self._shift)), bool)
        self._marks[(self.shingles >> self._shift).astype(np.int64)] = True
        #: shingles that any window has at least which holds an item: no shorter one can
        self.least = min((int(np.ceil(SIMILAR * size - 1e-9)) for size in self.groups), default=1)

    def perhaps(self, shingles: np.ndarray) -> np.ndarray:
        """Which may be an item's: all that are, and few others."""
        return self._marks[(shingles >> self._shift).astype(np.int64)]

    def proposals(self, own: np.ndarray) -> dict[int, set[int]]:
        """Item -> where the windows of a text's shingles begin whose fingerprint is near its own."""
        at = np.flatnonzero(self.perhaps(own))
        place = np.minimum(np.searchsorted(self.shingles, own[at]), len(self.shingles) - 1)
        same = self.shingles[place] == own[at]
        at, place = at[same], place[same]
        # a window shares no more with an item than the text has shingles of it, however often
        of, shared_with = np.unique(self.owners[words.spread(self.first[place], self.first[place + 1] - self.first[place])], return_counts=True)
        sizes = {self.sizes[i] for i, n in zip(of.tolist(), shared_with.tolist()) if n >= int(np.ceil(SIMILAR * self.sizes[i] - 1e-9))}
        starts: dict[int, set[int]] = {}
        if not sizes:
            return starts
        known = np.zeros(len(own), np.int64)
        known[at] = 1
        before = np.concatenate([[0], np.cumsum(known)])
        for size in sorted(sizes):
            index, owners = self.groups[size]
            width = min(size, len(own))
            need = least_shared(width, size)
            if need > width:
                continue
            at = np.flatnonzero(before[width:] - before[:-width] >= need)
            # windows one after another are fingerprinted together, STRIP of them at most
            runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
            for low, high in ((int(run[i]), int(run[min(i + STRIP, len(run)) - 1])) for run in runs for i in range(0, len(run), STRIP)):
                query, hit = index.within(window_fingerprints(own[low : high + width], width))
                for q, item in zip((low + query).tolist(), owners[hit].tolist()):
                    starts.setdefault(item, set()).add(q)
        return starts

    def matches(self, own: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, first shingle, similarity) of each item's best window in a text, SIMILAR or more; the first of equal ones."""
        out = []
        for item, starts in sorted(self.proposals(own).items()):
            counts, width = self.counts[item], min(self.sizes[item], len(own))
            best, at, last = (0.0, 0), None, None
            for start in sorted(starts):
                if at is None or start - at > width:
                    window = own[start : start + width].tolist()
                    have = Counter(x for x in window if x in counts)
                    both = sum(min(n, counts[x]) for x, n in have.items())
                else:  # the window moves on, shingle by shingle
                    for gone, come in zip(own[at:start].tolist(), own[at + width : start + width].tolist()):
                        if gone in counts:
                            both -= have[gone] <= counts[gone]
                            have[gone] -= 1
                        if come in counts:
                            both += have[come] < counts[come]
                            have[come] += 1
                at = start
                value = both / (width + self.sizes[item] - both)
                if value >= SIMILAR - 1e-12 and value > best[0]:
                    best, last = (value, start), start
            if last is not None:
                out.append((item, best[1], best[0]))
        return out


def item_parts(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> Iterator[list[tuple]]:
    """Items in parts of bounded size, by hash of their text; most benchmarks are one part."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    held = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-held.n // ITEMS), -(-held.b // ITEM_BYTES))
    for p in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p)
        yield [(r.id, r.text) for r in part.collect()]


def _hit(items: Items, chunk: words.Chunk) -> np.ndarray:
    """Documents of a chunk with as many shingles that may be an item's as any match has, and those with too few words for a shingle."""
    grams = words.ngrams(chunk.hashes, WORDS)
    before = np.concatenate([[0], np.cumsum(items.perhaps(grams))])
    first = np.minimum(chunk.first, len(grams))
    # shingles across the next document's words count as well: more is let through
    some = before[first[1:]] - before[first[:-1]] >= items.least
    return np.flatnonzero(some & (chunk.counts > 0) | (chunk.counts > 0) & (chunk.counts < WORDS))


def matches_of(items: Items, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(row, matches) of the texts that hold items."""
    if not items.ids:
        return
    for chunk in words.chunks(texts, lower=True, white=PLAIN):
        for d in _hit(items, chunk).tolist():
            found = items.matches(shingles_of(chunk.hashes[chunk.first[d] : chunk.first[d + 1]]))
            if found:
                yield chunk.row + d, found


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, first_word, similarity) per document and benchmark item that it holds.

    Words are runs of characters that are neither white space nor ASCII punctuation, A-Z
    lower-cased. A document holds an item when a window of the item's length (or the whole
    document, if shorter) has a weighted 5-word shingle similarity of 0.8 or more with it; the
    best window is reported, the first of equal ones (README says how many the fingerprints may miss). An item of fewer than five words is one
    shingle of its own, which only a document of just these words holds: a word or two would be
    found everywhere. Texts and items that are null or have no words hold and match nothing.
    Null ids are reported as null; rows that repeat an id each count; other columns are ignored,
    whatever their names; no rows make no rows. Memory is a strip of windows, whatever a text's length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for part in item_parts(benchmark):
        held = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = Items(held.value)
            for batch in batches:
                out = [(batch.column(0)[row].as_py(), items.ids[i], start, value) for row, found in matches_of(items, batch.column(1)) for i, start, value in found]
                if out:
                    columns = list(zip(*out))
                    yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], names=["doc_id", "item_id", "first_word", "similarity"])

        own = rows.mapInArrow(run, "doc_id long, item_id long, first_word long, similarity double")
        found = own if found is None else found.union(own)
    return found


def without(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all columns as they are: a pass with no shuffle."""
    kept = docs
    for part in item_parts(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = Items(held.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in matches_of(items, batch.column(text))]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item (see contaminated()).

    Null, empty and wordless texts stay, repeated rows each count, all columns stay as they
    are, and no rows make no rows.
    """
    shared.ready(spark)
    return without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
