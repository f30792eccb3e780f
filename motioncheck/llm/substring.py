"""Substring dedup: words in long passages that a document with a smaller id has too.

Method: compressed FM-indexes, one per shard. Passages that may be shared are found by
minimizers (of a window's 5-word hashes, the least), which equal windows have in common:

1. a pass posts each document's minimizers, packed per hash bucket, and marks those that two
   different texts have in a bitmap of fixed size; very frequent ones are listed;
2. a pass sends the stretches around marked minimizers to the minimizer's shard, equal ones once,
   with the least and largest id that has them;
3. a shard indexes its distinct stretches and streams them all against the index: backward
   search gives each window's interval, whose least document id tells if it is a repetition;
4. each document's stretches are joined with what was found of their kind, and its words outside
   the removed ranges kept.

A copy of a whole text repeats its first document throughout: it is found by the text's hash,
so that copies alone mark nothing. The bitmap only lets more stretches through, never fewer, so results are exact.

No shard is hot: equal stretches are one, and a frequent minimizer gives way to the least one of
its window that isn't, so passages that very many documents hold meet only at their inside, where
stretches are equal, while each of their edges goes where its own words say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.llm import shared, words
from motioncheck.llm.fm_index import FMIndex
from motioncheck.llm.suffixes import FIRST, SECOND, digests, distinct_kinds, distinct_pairs, pack_stretches, unpack_stretches

WIDTH = 13
#: Words of the hashes whose least is a window's minimizer.
GRAM = 5
#: The range of a copy.
COPY = -1
#: What a text's second hash is seeded with.
SECOND_SEED = "second"
#: Words that one index has, about; a larger shard is indexed in parts.
INDEXED = 1_500_000


#: Posts of a minimizer from which it may be frequent, whatever the size of the input.
FREQUENT = 64


def _posts(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """pack() of minimizers and owners, and, of bucket -1, frequent minimizers of a task with their counts."""

    def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        keys = batch.column(1).to_numpy().view(np.uint64)
        for chunk in words.chunks(batch.column(2)):
            starts, least = words.minimizers(chunk, width, GRAM)
            at = words.runs(starts, least)
            yield least[at], keys[chunk.row + chunk.doc_of_word()[starts[at]]]

    def reduce(hashes: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch | None]:
        yield from shared.owners_packed(hashes, owners, bits)
        found, times = np.unique(hashes, return_counts=True)
        # what is frequent in the whole is so in a task at least: in a share of its posts
        often = times >= max(2, min(FREQUENT, len(hashes) >> (bits + 4)))
        total = np.array([len(hashes)], np.int64).tobytes()
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([total + found[often].tobytes() + times[often].astype(np.int64).tobytes()], pa.binary())], names=["bucket", "block"])

    return docs.mapInArrow(lambda batches: shared.gathered(batches, make, reduce), shared.BLOCKS)


def _frequent(posts: DataFrame, bits: int) -> np.ndarray:
    """The minimizers that would fill an eighth of a bucket's share or more: so eight per bucket at most, ascending."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                total, rest = np.frombuffer(block.as_buffer(), np.int64, 1), np.frombuffer(block.as_buffer(), np.int64, offset=8)
                n = len(rest) // 2
                yield pa.record_batch([pa.array(np.append(rest[:n], 0)), pa.array(np.append(rest[n:], 0)), pa.array(np.append(np.zeros(n, np.int64), total))], names=["hash", "times", "total"])

    own = posts.where("bucket < 0").select("block").mapInArrow(spread, "hash long, times long, total long")
    sums = own.groupBy("hash").agg(F.sum("times").alias("times"), F.sum("total").alias("total"))
    total = sums.agg(F.sum("total")).first()[0] or 0
    found = [r.hash for r in sums.where(F.col("times") >= max(FREQUENT, total >> (bits + 3))).select("hash").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _routed(chunk: words.Chunk, width: int, marks: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the windows that may be shared, and where each goes: by its least minimizer that isn't frequent."""
    starts, least = words.minimizers(chunk, width, GRAM)
    keep = shared.marked(marks, least) if len(starts) else np.zeros(0, bool)
    if not len(frequent):
        return starts[keep], words.mix(least[keep])
    grams = words.ngrams(chunk.hashes, GRAM)
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    order = grams >> np.uint64(1) | (frequent[at] == grams).astype(np.uint64) << np.uint64(63)
    starts = starts[keep]
    first = np.full(len(starts), np.iinfo(np.uint64).max)
    for j in range(width - GRAM + 1):
        np.minimum(first, order[starts + j], out=first)
    return starts, words.mix(first)


def _entries(batches: Iterator[pa.RecordBatch], width: int, marks: np.ndarray, frequent: np.ndarray) -> Iterator[tuple]:
    """For each chunk of (doc_id, key, text): where stretches go, their words' hashes, lengths, ids, keys and places."""
    for batch in batches:
        ids, keys = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        for chunk in words.chunks(batch.column(2)):
            starts, to = _routed(chunk, width, marks, frequent)
            doc = chunk.doc_of_word()
            known = ~null[chunk.row + doc[starts]] if len(starts) else np.zeros(0, bool)
            starts, to = starts[known], to[known]
            at = words.runs(starts, to)
            if len(at):
                begins, lengths = starts[at], np.diff(np.append(at, len(starts))) + width - 1
                row = doc[begins]
                text = chunk.hashes[words.spread(begins, lengths)] >> np.uint64(16) << np.uint64(16)  # 48 bits count
                yield to[at], text, lengths, ids[chunk.row + row], keys[chunk.row + row], begins - chunk.first[row]


def _digests(text: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Two digests of each stretch's words of 48 bits: 128 bits, so that kinds of all documents don't collide."""
    return [digests(text, np.cumsum(lengths) - lengths, lengths, m) for m in (FIRST, SECOND)]


#: Words of stretches that a task gathers before it sends distinct ones.
GATHERED = 1 << 19


def _stretches(docs: DataFrame, held: Broadcast, width: int, bits: int) -> DataFrame:
    """Rows of (bucket, block): distinct stretches of words with the least and largest id that has them."""

    def sent(parts: list[tuple]) -> pa.RecordBatch:
        to, text, lengths, ids = (np.concatenate(p) for p in zip(*parts))
        one, low, high = distinct_pairs(*_digests(text >> np.uint64(16), lengths), ids, ids)
        firsts = np.cumsum(lengths) - lengths
        return pack_stretches(to[one], bits, text, firsts[one], lengths[one], low, high, np.zeros(len(one)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for entry in _entries(batches, width, *held.value):
            parts.append(entry[:4])
            size += len(entry[1])
            if size >= GATHERED:
                yield sent(parts)
                parts, size = [], 0
        if parts:
            yield sent(parts)

    return docs.mapInArrow(run, shared.BLOCKS)


def least_owners(least: np.ndarray, lengths: np.ndarray, text: np.ndarray, width: int, indexed: int = INDEXED) -> np.ndarray:
    """For each window of distinct stretches (one after another): the least id of any of them that holds it."""
    at = np.cumsum(lengths) - lengths
    starts = words.spread(at, lengths - width + 1)
    best = np.full(len(starts), np.iinfo(np.int64).max)
    parts = np.concatenate([[0], np.flatnonzero(np.diff((at + lengths) // indexed)) + 1, [len(at)]])
    for a, b in zip(parts, parts[1:]):
        if a < b:
            index = FMIndex(text[at[a] : at[b - 1] + lengths[b - 1]], lengths[a:b], least[a:b])
            for low in range(0, len(starts), 1 << 17):  # matching statistics of the streamed windows
                span = slice(low, low + (1 << 17))
                best[span] = np.minimum(best[span], index.minimum(*index.intervals(text, starts[span], width)))
    return best


def hit_ranges(ids: np.ndarray, places: np.ndarray, counts: np.ndarray, best: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries with `counts` windows each (best: of all, one after another): entry, and the range of the document's words (from, to) that repeat a smaller id's."""
    entry = np.repeat(np.arange(len(ids)), counts)
    offset = words.spread(np.zeros(len(ids), np.int64), counts)
    hit = best < ids[entry]
    entry, offset = entry[hit], offset[hit]
    if not len(entry):
        return entry, entry, entry
    new = np.concatenate([[True], (entry[1:] != entry[:-1]) | (offset[1:] > offset[:-1] + width)])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(entry) - 1)
    which = entry[new]
    return which, places[which] + offset[new], places[which] + offset[last] + width


def repeated(ids: np.ndarray, places: np.ndarray, lengths: np.ndarray, text: np.ndarray, width: int, indexed: int = INDEXED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What hit_ranges() finds for the entries of one shard: the steps in a row, on one machine."""
    lengths = lengths.astype(np.int64)
    firsts = np.cumsum(lengths) - lengths
    kind = digests(text, firsts, lengths)
    one, low, _ = distinct_kinds(kind, ids, ids)
    of = np.searchsorted(kind[one], kind)
    best = least_owners(low, lengths[one], text[words.spread(firsts[one], lengths[one])], width, indexed)
    counts = lengths[one] - width + 1
    return hit_ranges(ids, places, counts[of], best[words.spread((np.cumsum(counts) - counts)[of], counts[of])], width)


def _ranges(docs: DataFrame, stretches: DataFrame, held: Broadcast, width: int, folder: str) -> DataFrame:
    """(id, key, range) of what repeats a smaller id's words."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in shared.by_bucket(batches):
            low, high, _, lengths, text = unpack_stretches(blocks)
            lengths = lengths.astype(np.int64)
            firsts = np.cumsum(lengths) - lengths
            kind, check = _digests(text, lengths)
            one, low, high = distinct_pairs(kind, check, low, high)
            best = least_owners(low, lengths[one], text[words.spread(firsts[one], lengths[one])], width)
            counts = lengths[one] - width + 1
            starts = np.cumsum(counts) - counts
            some = np.flatnonzero(np.minimum.reduceat(best, starts) < high)  # of others, no document loses a word
            own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[some])), pa.int32()), pa.array(best[words.spread(starts[some], counts[some])]))
            yield pa.record_batch([*(pa.array(x[one][some].view(np.int64)) for x in (kind, check)), own], names=["kind", "check", "best"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text, lengths, ids, keys, places in _entries(batches, width, *held.value):
            yield pa.record_batch([*(pa.array(x.view(np.int64)) for x in _digests(text >> np.uint64(16), lengths)), pa.array(ids), pa.array(keys), pa.array(places)], names=["of", "of_check", "id", "key", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, places, best = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            entry, low, high = hit_ranges(ids, places, np.diff(best.offsets.to_numpy()), best.flatten().to_numpy(), width)
            yield pa.record_batch([pa.array(ids[entry]), pa.array(keys[entry]), pa.array(low << 32 | high)], names=["id", "key", "range"])

    found = shared.written(shared.dealt(stretches).mapInArrow(search, "kind long, check long, best array<long>"), f"{folder}/found")
    entries = docs.mapInArrow(place, "of long, of_check long, id long, key long, place long")
    # a kind that very many documents have is a row here: a join that Spark can split
    return entries.join(found, (F.col("of") == F.col("kind")) & (F.col("of_check") == F.col("check"))).select("id", "key", "place", "best").mapInArrow(cut, "id long, key long, range long")


def _copies(rows: DataFrame, folder: str) -> DataFrame:
    """(id, key, range) of rows whose whole text a smaller id has, by its key and a second hash: 128 bits."""
    rows = rows.select("doc_id", "key", "text", F.xxhash64(F.lit(SECOND_SEED), "text").alias("check"))
    first = rows.where("doc_id is not null and text is not null").groupBy("key", "check").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = shared.written(first.select(F.col("key").alias("of"), F.col("check").alias("of_check"), "first"), f"{folder}/first")
    return rows.select("doc_id", "key", "check").join(first, (F.col("key") == F.col("of")) & (F.col("check") == F.col("of_check")) & (F.col("doc_id") > F.col("first"))).select(F.col("doc_id").alias("id"), "key", F.lit(COPY).cast("long").alias("range"))


def _kept(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ranges) to doc_id, n_words, n_removed, kept text; the text is as it was if nothing goes."""
    for batch in batches:
        texts, ranges = batch.column(1), batch.column(2)
        n_words, n_removed, kept = [], [], []
        for chunk in words.chunks(texts):
            base = np.zeros(chunk.docs + 1, np.int64)
            for d in range(chunk.docs):
                a, b = chunk.first[d], chunk.first[d + 1]
                own = ranges[chunk.row + d]
                out = np.zeros(b - a + 1, np.int32)
                if own.is_valid:
                    packed = own.values.to_numpy()
                    if packed.min() == COPY:
                        packed = np.array([b - a] if b - a >= width else [], np.int64)
                    np.add.at(out, packed >> 32, 1)
                    np.add.at(out, packed & 0xFFFFFFFF, -1)
                stay = a + np.flatnonzero(np.cumsum(out[:-1]) == 0)
                n_words.append(int(b - a))
                n_removed.append(int(b - a - len(stay)))
                raw = chunk.raw
                # runs of words between which there is one space are taken at once
                joined = np.flatnonzero(np.concatenate([[True], (stay[1:] != stay[:-1] + 1) | (chunk.starts[stay[1:]] != chunk.ends[stay[:-1]] + 1) | (raw[chunk.ends[stay[:-1]]] != 32), [True]])) if len(stay) else base[:0]
                kept.append(b" ".join(raw[chunk.starts[stay[x]] : chunk.ends[stay[y - 1]]].tobytes() for x, y in zip(joined, joined[1:])))
        yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), *batch.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256", *batch.schema.names[3:]])


def dedup_substrings(docs: DataFrame, width: int = WIDTH, text: str = "text", id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256, *keep) per row of docs.

    A window is `width` consecutive words (at least 9) of one document. Words of windows that
    also start in a document with a smaller id are removed; the rest is joined by one space.
    Null or empty text has no words and keeps the empty text. A null id is smaller and larger
    than none: its row keeps all. Rows that repeat an id don't repeat each other. `keep` names
    columns to carry along; others are ignored, whatever their names; no rows make no rows.
    """
    if width <= max(GRAM, 8):
        raise ValueError("width must be 9 or more")
    spark = docs.sparkSession
    folder = shared.workspace(spark)
    bits = shared.bucket_bits(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    own = rows.select("doc_id", "key", "text")
    posts = shared.written(_posts(own, width, bits), f"{folder}/posts")
    held = spark.sparkContext.broadcast((shared.shared_bitmap(posts.where("bucket >= 0"), bits), _frequent(posts, bits)))
    shared.remove(spark, f"{folder}/posts")
    ranges = _ranges(own, _stretches(own, held, width, bits), held, width, folder).union(_copies(own, folder)).groupBy("id", "key").agg(F.collect_list("range").alias("ranges"))
    ranges = shared.written(ranges, f"{folder}/ranges").withColumnRenamed("key", "own_key")
    joined = rows.join(ranges, (rows.doc_id == ranges.id) & (rows.key == ranges.own_key), "left")
    kept = joined.select("doc_id", "text", "ranges", *[f"keep_{i}" for i in range(len(keep))])
    kinds = ", ".join(["doc_id long, n_words long, n_removed long, kept string, kept_sha256 string", *(f"keep_{i} {rows.schema[f'keep_{i}'].dataType.simpleString()}" for i in range(len(keep)))])
    out = kept.mapInArrow(lambda batches: _kept(batches, width), kinds)
    # a carried column with the name of a figure takes its place
    own = [c for c in ("doc_id", "n_words", "n_removed", "kept", "kept_sha256") if c not in keep]
    return out.select(*own, *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated passages taken out of the text; n_chars, where there is one, follows.

    Untouched texts stay as they are, null and empty ones too; documents of which nothing is
    left go. Repeated rows and null ids as in dedup_substrings(); all columns stay; no rows make no rows.
    """
    shared.ready(spark)
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    done = dedup_substrings(docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()]), keep=tuple(names.values()))
    cut = F.col("n_removed") > 0
    put = {"text": F.when(cut, F.col("kept")).otherwise(F.col(names["text"]))}
    if "n_chars" in names:
        put["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return done.where(~cut | (F.col("n_removed") < F.col("n_words"))).select(*[put.get(c, F.col(n)).alias(c) for c, n in names.items()])
