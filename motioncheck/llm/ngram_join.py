"""N-gram Jaccard join: documents whose word shingle sets are similar, and their groups.

Method: a prefix-tree join of globally ordered sets:

1. a pass posts the first shingles of each set by hash, packed per hash bucket, and marks
   those that two different sets have in a bitmap of fixed size;
2. a pass keeps a set when enough of its first shingles are marked for a partner to exist;
3. the kept sets' shingles are ordered by frequency (by a table of fixed size), rare ones
   first; sets that share enough prefix shingles and are near in size form candidate clusters;
4. a cluster's sets are stored in a trie and joined by traversing it with shared partial
   overlaps, pruned by bounds of the remaining lengths. In a large cluster, sets are compared
   with one centre of their size band first; then it is cut into blocks, and every pair of
   blocks that may hold a link between sets that aren't connected yet is a unit of its own.

Every bound is exact, so no link between different sets is lost. Equal sets are one set
throughout, so copies cost a row each and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.llm import shared, words
from motioncheck.llm.trie import self_join

WORDS = 5
#: Similarity at least NUM / DEN.
NUM, DEN = 4, 5
#: Of a set, the share of shingles that step 1 posts: over 1 - NUM / DEN.
POSTED = 0.3
#: Bits of the table of shingles' frequencies: a byte each, 16 MB.
LEVEL_BITS = 24
#: Shingles that a block of a large cluster has, about; a unit joins two blocks.
BLOCK = 60_000
#: Sets that share a prefix shingle and are met in pairs, at most; more are chained by size.
RUN = 64

SETS = "doc_id long, n_shingles long, d1 long, d2 long, posted binary"


def _needed(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n that a partner has at least."""
    return -(-NUM * n // DEN)


def _posted(n: np.ndarray) -> np.ndarray:
    return np.maximum(n - _needed(n) + np.minimum(n, 1), np.ceil(POSTED * n).astype(np.int64))


def _both_posted(n: int) -> int:
    """Shingles that a set of n and any partner both post, at least.

    With an overlap of o, sets of n and m post the first posted(n) - (n - o) and posted(m) - (m - o)
    of their common shingles at least, in one order; both post the fewer of the two.
    """
    least = n
    for m in range(_needed(np.int64(n)), DEN * n // NUM + 1):
        o = -(-NUM * (n + m) // (NUM + DEN))
        if o <= min(n, m):
            least = min(least, *(int(_posted(np.int64(x))) - x + o for x in (n, m)))
    return least


#: _both_posted() of small sets. From 80 on a partner's side never is the fewer one: it posts
#: n / 8 of them at least, and the own side needs n / 10 + 2 at most.
SMALL = np.array([_both_posted(n) for n in range(100)])


def _marked_least(n: np.ndarray) -> np.ndarray:
    """Of a set's posted shingles, how many are marked at least if it has a partner."""
    return np.where(n < len(SMALL), SMALL[np.minimum(n, len(SMALL) - 1)], _posted(n) - n + _needed(n))


def _sets(text: pa.Array, k: int) -> Iterator[tuple]:
    """For each chunk: chunk, hashes, first, sizes, two digests of each set, each hash's place in its set."""
    for chunk in words.chunks(text, lower=True):
        hashes, first = words.shingle_sets(chunk, k)
        n = np.diff(first)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(words.mix(hashes + np.uint64(salt)))]) for salt in (1, 2)]
        d1, d2 = (words.mix(s[first[1:]] - s[first[:-1]] + n.astype(np.uint64)) for s in sums)
        yield chunk, hashes, first, n, d1, d2, np.arange(len(hashes)) - np.repeat(first[:-1], n)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2) per row: its set's size and two digests."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, n, d1, d2, _ in _sets(batch.column(1), k):
            yield pa.record_batch([batch.column(0).slice(chunk.row, chunk.docs), _long(n), _long(d1), _long(d2)], names=["doc_id", "n_shingles", "d1", "d2"])

    return docs.mapInArrow(lambda batches: shared.each(batches, make), "doc_id long, n_shingles long, d1 long, d2 long")


def _first_shingles(docs: DataFrame, k: int, bits: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for _, hashes, _, n, d1, _, place in _sets(batch.column(1), k):
            keep = place < np.repeat(_posted(n), n)
            yield hashes[keep], np.repeat(d1, n)[keep]

    return docs.mapInArrow(lambda batches: shared.gathered(batches, make, lambda *c: shared.owners_packed(*c, bits)), shared.BLOCKS)


def _candidates(docs: DataFrame, marks: np.ndarray, k: int) -> DataFrame:
    """The whole sets of documents that may have a partner."""
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk, hashes, first, n, d1, d2, place in _sets(batch.column(1), k):
            early = place < np.repeat(_posted(n), n)
            found = np.zeros(len(hashes) + 1, np.int64)
            found[1:][early] = shared.marked(held.value, hashes[early])
            found = np.cumsum(found)
            take = np.flatnonzero((n > 0) & (found[first[1:]] - found[first[:-1]] >= _marked_least(n)))
            blobs = pa.array([hashes[first[d] : first[d + 1]].tobytes() for d in take], pa.binary())
            yield pa.record_batch([batch.column(0).slice(chunk.row, chunk.docs).take(pa.array(take)), _long(n[take]), _long(d1[take]), _long(d2[take]), blobs], names=["doc_id", "n_shingles", "d1", "d2", "hashes"])

    found = docs.mapInArrow(lambda batches: shared.each(batches, make), "doc_id long, n_shingles long, d1 long, d2 long, hashes binary")
    return found.where("doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("hashes").alias("hashes"))


def _levels(sets: DataFrame, bits: int) -> np.ndarray:
    """How common shingles are among the candidates: by the hash's top LEVEL_BITS bits, the logarithm of the largest count."""

    def post(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for h in batch.column(0):
            yield (np.frombuffer(h.as_buffer(), np.uint64),)

    def counted(hashes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return hashes[first], np.diff(np.append(first, len(hashes))) if times is None else np.add.reduceat(times[order], first)

    def reduce(hashes: np.ndarray) -> Iterator[pa.RecordBatch | None]:
        yield shared.slim((own := counted(hashes))[0], bits, (np.minimum(own[1], 0xFFFF), 2))

    per, shift = 1 << (LEVEL_BITS - bits), np.uint64(64 - LEVEL_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in shared.by_bucket(batches):
            hashes, times = counted(*shared.unslim(bucket, blocks, bits, 2))
            level = np.log2(times).astype(np.uint8)
            if level.any():
                own = np.zeros(per, np.uint8)
                np.maximum.at(own, (hashes >> shift).astype(np.int64) & (per - 1), level)
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["bucket", "block"])

    table = np.zeros(1 << LEVEL_BITS, np.uint8)
    for row in shared.dealt(sets.select("hashes").mapInArrow(lambda batches: shared.gathered(batches, post, reduce), shared.BLOCKS)).mapInArrow(count, shared.BLOCKS).collect():  # at most the table's own size
        table[row.bucket * per : (row.bucket + 1) * per] = np.frombuffer(row.block, np.uint8)
    return table


def chained(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Chains of sets that share a hash, by size: (hash, least size, largest size, least id) of each, and (least id, id) of those joined.

    low, high, ids: of sets or of chains. One chain goes on where the next size is near in ratio.
    """
    order = np.lexsort((low, hashes))
    hashes, low, high, ids = hashes[order], low[order], high[order], ids[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    group = np.cumsum(new) << 40  # sizes are below 2**40
    reach = np.maximum.accumulate(group + high) - group
    begins = np.flatnonzero(new | np.concatenate([[True], DEN * reach[:-1] < NUM * low[1:]]))
    least, ends = np.minimum.reduceat(ids, begins), np.append(begins[1:], len(ids)) - 1
    pairs = np.stack([np.repeat(least, ends + 1 - begins), ids], 1)
    return (hashes[begins], low[begins], reach[ends], least), np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _prefix(levels: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set's prefix that another candidate may have, and their places in the set's order: rare ones first, then by hash.

    A shingle of level 0 is of one set alone. The order is one of the shingles, the same in all sets.
    """
    level = levels[(hashes >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")[: len(hashes) - int(_needed(np.int64(len(hashes)))) + 1]
    places = np.flatnonzero(level[order])
    return hashes[order[places]], places


def met(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, n, m, i, j) of every two sets that share a hash and are near in size: ids, sizes, n <= m, and places. Some at a time.

    Where more than RUN share it, or some are chained already (place -1), they are chained: (a, b, 0, 0, 0, 0).
    """
    order = np.lexsort((low, hashes))
    hashes, low, high, ids, places = hashes[order], low[order], high[order], ids[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    length = np.diff(np.append(first, len(hashes)))
    chain = np.repeat((length > RUN) | (np.minimum.reduceat(places, first) < 0), length)
    if chain.any():
        pairs = chained(hashes[chain], low[chain], high[chain], ids[chain])[1]
        yield pairs[:, 0], pairs[:, 1], *[np.zeros(len(pairs), np.int64)] * 4
    end, at = np.repeat(first + length, length), np.flatnonzero(~chain)
    for step in range(1, RUN):  # a set and the next larger one, then the one after that, ...
        at = at[at + step < end[at]]
        at = at[DEN * low[at] >= NUM * low[at + step]]
        if not len(at):
            return
        to = at + step
        yield ids[at], ids[to], low[at], low[to], places[at], places[to]


def _cluster_edges(sets: DataFrame, levels: np.ndarray, bits: int, folder: str) -> DataFrame:
    """(a, b): sets that share so many prefix shingles that they may link: all candidates are connected.

    A pair's common shingles are counted up to the end of either prefix; beyond it, the set whose prefix
    that is has all but its prefix left, at most. Before the first common one, nothing is common. So
    sets that share a few shingles by chance, as more do in larger tables, aren't connected. Of a
    shingle that very many sets have in their prefix, sets are chained by size instead, uncounted; a task
    chains its own ones first, so such a shingle isn't hot.
    """
    held = sets.sparkSession.sparkContext.broadcast(levels)
    kinds = (np.int32, np.int32, np.int64, np.int32)

    def post(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for i, h in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(h.as_buffer(), np.uint64)
            early, places = _prefix(held.value, own)
            yield early, np.full(len(early), len(own)), np.full(len(early), i), places

    def reduce(hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch | None]:
        _, of, times = np.unique(hashes, return_inverse=True, return_counts=True)
        chain = times[of] > RUN
        columns = [hashes[~chain], sizes[~chain], sizes[~chain], ids[~chain], places[~chain]]
        if chain.any():
            chains, pairs = chained(hashes[chain], sizes[chain], sizes[chain], ids[chain])
            columns = [np.concatenate(c) for c in zip(columns, (*chains, np.full(len(chains[0]), -1)))]
            if len(pairs):  # known already: of no bucket
                yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([pairs.tobytes()], pa.binary())], names=["bucket", "block"])
        yield shared.pack(columns[0], bits, *(c.astype(k) for c, k in zip(columns[1:], kinds)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in shared.by_bucket(batches):
            hashes, *columns = shared.unpack(blocks, *kinds)
            for a, b, n, m, i, j in met(hashes, *(c.astype(np.int64) for c in columns)):
                yield pa.record_batch([pa.array(c) for c in (np.minimum(a, b), np.maximum(a, b), n, m, i, j)], names=["a", "b", "n", "m", "i", "j"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield _pairs(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, 2))

    posts = shared.written(sets.select("id", "hashes").mapInArrow(lambda batches: shared.gathered(batches, post, reduce), shared.BLOCKS), f"{folder}/posts")
    pairs = shared.dealt(posts.where("bucket >= 0")).mapInArrow(meet, "a long, b long, n long, m long, i long, j long").where("a <> b")
    pairs = pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"), F.min("i").alias("i"), F.min("j").alias("j"))
    needed = F.ceil(NUM * (F.col("n") + F.col("m")) / (NUM + DEN))
    may = (F.col("c") + F.ceil(NUM * F.col("m") / DEN) - 1 >= needed) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= needed)
    return pairs.where((F.col("n") == 0) | may).select("a", "b").union(posts.where("bucket < 0").select("block").mapInArrow(known, "a long, b long"))


def _banded(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, n_shingles, label, band): a pair's bands are one apart at most; the little more guards against rounding."""
    return sets.select("id", "n_shingles").join(clusters, "id").withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(DEN / NUM + 0.001))).cast("int"))


def _centre_links(sets: DataFrame, banded: DataFrame, block: int) -> DataFrame:
    """(a, b): links of the sets of large clusters to the set of the least id in their band: a row for each set.

    A large cluster is mostly near copies, and what links to one centre is connected: pairs
    among it needn't be looked at. A centre may have any number of sets: rows are joined to it,
    by a join that Spark can split, and compared one by one.
    """
    large = banded.groupBy("label").agg(F.sum("n_shingles").alias("total")).where(F.col("total") > 2 * block).select("label")
    centres = banded.join(large, "label", "left_semi").groupBy("label", "band").agg(F.min("id").alias("centre"))
    meets = banded.join(centres, ["label", "band"]).where("id <> centre").select("id", "centre")
    above = centres.select("label", (F.col("band") - 1).alias("band"), F.col("centre").alias("id"))
    meets = meets.union(above.join(centres, ["label", "band"]).select("id", "centre"))  # centres of neighbouring bands
    own = sets.select("id", "hashes")
    both = meets.join(own, "id").join(own.select(F.col("id").alias("centre"), F.col("hashes").alias("of")), "centre").select("centre", "id", "of", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared_ones = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(DEN * shared_ones >= NUM * (len(x) + len(y) - shared_ones))
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _units(sets: DataFrame, banded: DataFrame, cores: DataFrame, block: int) -> DataFrame:
    """Each set in each task that joins it: (unit, id, hashes). A small cluster is one unit.

    A large one is cut into bands, these by what is connected already (cores: id, core), and
    these into blocks; each pair of blocks that may hold a link between unconnected sets is a unit.
    """
    # all of it without the sets themselves, which are joined to their units at the end
    within = banded.join(cores, "id", "left")
    parts = within.groupBy("label", "band", "core").agg(F.sum("n_shingles").alias("weight"))
    part = F.struct("band", "core", F.ceil(F.col("weight") / F.lit(float(block))).cast("int").alias("blocks"))
    total = parts.groupBy("label").agg(F.sum("weight").alias("total"), F.collect_list(part).alias("parts"))  # a few per band
    within = within.join(total, "label")
    mine = F.filter("parts", lambda p: (p["band"] == F.col("band")) & p["core"].eqNullSafe(F.col("core")))[0]
    own = F.struct(F.col("band").alias("b"), F.col("core").alias("c"), F.pmod(F.xxhash64("id"), mine["blocks"]).cast("int").alias("k"))
    near = F.filter("parts", lambda p: (F.abs(p["band"] - F.col("band")) <= 1) & ~F.coalesce(p["core"] == F.col("core"), F.lit(False)))
    others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda k: F.struct(p["band"].alias("b"), p["core"].alias("c"), k.alias("k")))))
    pairs = F.transform(others, lambda o: F.struct(F.least(own, o).alias("one"), F.greatest(own, o).alias("two")))
    cell = F.struct(F.lit(0).alias("b"), F.lit(None).cast("long").alias("c"), F.lit(0).alias("k"))
    whole = F.array(F.struct(cell.alias("one"), cell.alias("two")))
    placed = within.select("id", "label", F.explode(F.when(F.col("total") <= 2 * block, whole).otherwise(pairs)).alias("cells"))
    return sets.select("id", "hashes").join(placed.select("id", F.struct("label", "cells").alias("unit")), "id")


def _links(units: DataFrame) -> DataFrame:
    """(a, b): links of each unit that connect what its links connect."""
    keyed = units.select(F.xxhash64("unit").alias("unit"), "id", "hashes")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            found = self_join(sets, NUM, DEN)
            return pa.record_batch([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], names=["a", "b"])

        at, ids, sets = None, [], []
        for batch in batches:
            for unit, i, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if unit != at and ids:
                    if len(ids) > 1:
                        yield flush(ids, sets)
                    ids, sets = [], []
                at = unit
                ids.append(i)
                sets.append(np.frombuffer(hashes.as_py(), np.uint64))
        if len(ids) > 1:
            yield flush(ids, sets)

    n = shared.shuffle_partitions(units.sparkSession)
    return keyed.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(join, "a long, b long")


def ngram_groups(docs: DataFrame, k: int = WORDS, text: str = "text", id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs.

    A document's set: its distinct k-word shingles, A-Z lower-cased; with fewer words the
    whole sequence; with none, or null text, it is empty and linked with nothing.
    component_id is the smallest id reachable by links. Links between sets that others connect
    already are not looked for, so their number isn't known. Null ids get a null component and
    link with nothing; rows that repeat an id are one node; other columns are ignored, whatever
    their names; no rows make no rows.
    """
    spark = docs.sparkSession
    folder = shared.workspace(spark)
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bits = shared.bucket_bits(spark)
    sizes = shared.written(signatures(docs, k), f"{folder}/sizes")
    marks = shared.shared_bitmap(_first_shingles(docs, k, bits), bits)
    sets = shared.written(_candidates(docs, marks, k), f"{folder}/sets")
    clusters = shared.components(_cluster_edges(sets, _levels(sets, bits), bits, folder), f"{folder}/clusters")
    banded = shared.written(_banded(sets, clusters), f"{folder}/banded")
    centre_links = shared.written(_centre_links(sets, banded, block), f"{folder}/centres")
    cores = shared.components(centre_links, f"{folder}/cores").withColumnRenamed("label", "core")
    links = shared.written(_links(_units(sets, banded, cores, block)).union(centre_links), f"{folder}/links")
    groups = shared.written(shared.components(links, f"{folder}/groups"), f"{folder}/components")
    # equal sets have one representative, and its component is theirs
    like = sizes.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    like = like.join(groups, "id", "left").where("copies > 1 or label is not null").select("d1", "d2", "n_shingles", F.coalesce("label", "id").alias("label"))
    like = shared.written(like, f"{folder}/labels")
    found = sizes.join(like.withColumnRenamed("n_shingles", "n"), (sizes.d1 == like.d1) & (sizes.d2 == like.d2) & (sizes.n_shingles == F.col("n")) & sizes.doc_id.isNotNull(), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the smallest id of their group; equal rows of one id stay, and null ids.

    Null, empty and wordless texts are groups of their own; all columns stay as they are; no rows make no rows.
    """
    shared.ready(spark)
    others = ngram_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct()
    others = shared.written(others, f"{shared.workspace(spark)}/others")  # few and known: texts aren't shuffled up to Spark's limit of a broadcast
    return docs.join(others, docs["doc_id"] == others["_other"], "left_anti")
