"""Shuffles of packed blocks, bitmaps of shared hashes, connected components, and written tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.llm.words import distinct

#: Bits of a bitmap of shared hashes, at most. 2**27 bits are 16 MB on the driver and in each worker.
BITMAP_BITS = 27


#: Rows of a batch that goes to a worker, where the session has Spark's own default: texts are long.
BATCH_ROWS = "2000"


def ready(spark: SparkSession) -> None:
    """Lets workers on machines that have this package at the driver's path import it, and keeps their batches small.

    Elsewhere, install the package or ship it with --py-files.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def workspace(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_motioncheck"
    return f"{root.rstrip('/')}/motioncheck-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """df as a written table: its lineage ends here, and any executor can read it again.

    The folder is deleted when the application ends.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path, compression=compression)

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone, and its folder with it
            return

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_bits(spark: SparkSession) -> int:
    """Buckets are a power of two, about eight to a shuffle partition."""
    return min(18, max(4, (8 * shuffle_partitions(spark) - 1).bit_length()))


BLOCKS = "bucket int, block binary"


def pack(hashes: np.ndarray, bits: int, *columns: np.ndarray) -> pa.RecordBatch | None:
    """A row per bucket (the top bits of the hash): its hashes ascending, then each column's values for them."""
    if not len(hashes):
        return None
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(hashes)]])
    columns = [c[order] for c in columns]
    blocks = [b"".join([np.uint32(b - a).tobytes(), hashes[a:b].tobytes(), *(c[a:b].tobytes() for c in columns)]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.record_batch([pa.array(buckets[cuts[:-1]]), pa.array(blocks, pa.binary())], names=["bucket", "block"])


#: Posts that a task gathers before it reduces and packs them.
POSTS = 1 << 19


def gathered(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], reduce: Callable[..., Iterator[pa.RecordBatch | None]]) -> Iterator[pa.RecordBatch]:
    """reduce() of the columns that make() gives, many batches together: what all of them have is posted once."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for columns in make(batch):
            if len(columns[0]):
                held.append(columns)
                size += len(columns[0])
            if size >= POSTS:
                yield from (x for x in reduce(*(np.concatenate(c) for c in zip(*held))) if x is not None and x.num_rows)
                held, size = [], 0
    if held:
        yield from (x for x in reduce(*(np.concatenate(c) for c in zip(*held))) if x is not None and x.num_rows)


def owners_packed(hashes: np.ndarray, owners: np.ndarray, bits: int) -> Iterator[pa.RecordBatch | None]:
    """slim() of hash and owner, with two owners of each hash at most: whether several have it is all that is asked."""
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    low, high = np.minimum.reduceat(owners, first), np.maximum.reduceat(owners, first)
    more = low != high
    yield slim(np.concatenate([hashes[first], hashes[first][more]]), bits, (np.concatenate([low, high[more]]), OWNER))


def unpack(blocks: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The columns of blocks made by pack(), hashes first."""
    parts: list[list[np.ndarray]] = [[] for _ in range(1 + len(kinds))]
    for x in blocks:
        n, at = int(np.frombuffer(x, np.uint32, 1)[0]), 4
        for part, kind in zip(parts, (np.uint64, *kinds)):
            part.append(np.frombuffer(x, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


#: Bytes that slim() keeps of a hash, after its bucket's bits, and of an owner's digest. What is alike in these only seems
#: shared, which lets more through; two owners that are alike in OWNER, one pair in 2**40, seem one.
SLIM, OWNER = 4, 5


def slim(hashes: np.ndarray, bits: int, *columns: tuple[np.ndarray, int]) -> pa.RecordBatch | None:
    """pack() in fewer bytes, as such blocks are the largest shuffle: SLIM of each hash after its bucket's bits, and of each column (values, bytes) its low bytes."""
    if not len(hashes):
        return None
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(hashes)]])
    rest = hashes << np.uint64(bits) >> np.uint64(64 - 8 * SLIM)
    low = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]) for c, w in ((rest, SLIM), *((c[order], w) for c, w in columns))]
    blocks = [b"".join([np.uint32(b - a).tobytes(), *(c[a:b].tobytes() for c in low)]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.record_batch([pa.array(buckets[cuts[:-1]]), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def unslim(bucket: int, blocks: list[bytes], bits: int, *widths: int) -> list[np.ndarray]:
    """The columns of a bucket's blocks made by slim(), as uint64: hashes first, with zeros below the bytes that were sent."""
    parts: list[list[np.ndarray]] = [[] for _ in range(1 + len(widths))]
    for x in blocks:
        n, at = int(np.frombuffer(x, np.uint32, 1)[0]), 4
        for part, w in zip(parts, (SLIM, *widths)):
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :w] = np.frombuffer(x, np.uint8, n * w, at).reshape(n, w)
            part.append(wide.view("<u8").ravel())
            at += n * w
    found = [np.concatenate(p) for p in parts]
    found[0] = np.uint64(bucket) << np.uint64(64 - bits) | found[0] << np.uint64(64 - 8 * SLIM) >> np.uint64(bits)
    return found


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blocks of one bucket after another, from rows sorted by bucket."""
    at, have = None, []
    for batch in batches:
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != at and have:
                yield at, have
                have = []
            at = bucket
            have.append(block.as_py())
    if have:
        yield at, have


def dealt(blocks: DataFrame) -> DataFrame:
    """Each bucket whole in one partition, one bucket after another."""
    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket")


def shared_bitmap(blocks: DataFrame, bits: int, bitmap_bits: int = BITMAP_BITS, owned: bool = True) -> np.ndarray:
    """A bitmap of the hashes that two or more owners have, by the hashes' top bits.

    blocks: owners_packed(), whose owners are digests: 40 of their bits count. Other hashes with the same top bits are marked
    too, so a clear bit proves that no other owner has the hash. What reaches the driver is
    the bitmap's size, whatever the input's. Without owners, blocks are slim() of hashes alone, and each hash that was
    posted twice is marked.
    """
    shift, per = np.uint64(64 - bitmap_bits), 1 << (bitmap_bits - bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, packed in by_bucket(batches):
            hashes, *owners = unslim(bucket, packed, bits, *([OWNER] if owned else []))
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            other = hashes[1:] == hashes[:-1]
            for own in owners:  # a run of one hash is shared if its owners aren't all the same
                other &= own[order][1:] != own[order][:-1]
            found = hashes[1:][other]
            if len(found):
                at = distinct((found >> shift).astype(np.int64) & (per - 1))
                if per >= 8 and 32 * len(at) > per:
                    bits_of = np.zeros(per, np.uint8)
                    bits_of[at] = 1
                    yield pa.record_batch([pa.array([~bucket], pa.int32()), pa.array([np.packbits(bits_of, bitorder="little").tobytes()], pa.binary())], names=["bucket", "block"])
                else:
                    yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary())], names=["bucket", "block"])

    marks = np.zeros(1 << (bitmap_bits - 3), np.uint8)
    for row in dealt(blocks).mapInArrow(mark, BLOCKS).collect():  # at most the bitmap's own size
        if row.bucket < 0:
            marks[~row.bucket * per // 8 : (~row.bucket + 1) * per // 8] = np.frombuffer(row.block, np.uint8)
        else:
            at = np.frombuffer(row.block, np.uint32).astype(np.int64) + row.bucket * per
            np.bitwise_or.at(marks, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return marks


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - (len(marks) * 8 - 1).bit_length())).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, label) of every id in edges (a long, b long): the smallest id that it reaches.

    Alternating large and small stars: edges move to smaller neighbours until only stars
    are left. A star's centre may have any number of rows: minima are pre-aggregated,
    and the join back to the edges is one that Spark can split.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, f"{folder}/edges-0")
    mark, step = None, 0
    while True:
        step += 1
        both = now.union(now.select("v", "u"))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, f"{folder}/edges-{step}-large")
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        moved = large.join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(moved.union(low.select("k", "m")).distinct(), f"{folder}/edges-{step}")
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        # the rounds before this one aren't read again
        remove(spark, f"{folder}/edges-{step - 1}")
        remove(spark, f"{folder}/edges-{step}-large")
        if (found.n, found.s) == mark:
            break
        mark = (found.n, found.s)
    centres = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(centres)


def each(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | None]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in make(batch):
            if out is not None and out.num_rows:
                yield out
