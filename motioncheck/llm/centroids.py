"""Centroid clustering of quantised vectors, in exact integers.

Method: weighted deduplication. Vectors are quantised, and identical ones are grouped with their
multiplicity before anything else is done. Lloyd's rounds run on the distinct vectors, each
counted as often as it occurs, with sums of integers; so a vector with a third of all rows is one
row of every round. The last assignment is joined back to the rows.

A quantised vector travels as the bytes of its components in the narrowest of three kinds (16
bits, 32 bits, doubles that are whole numbers), so equal vectors have equal bytes and a vector of
64 small components takes 128 bytes. Sums over tasks are added in limbs of 48 bits, so they are
exact whatever the components' size and the number of rows; what reaches the driver is a sum per
centroid and component. Distances are exact too: in doubles where every step stays below 2 ** 53,
in Python's integers elsewhere.

Hot vectors: only those with HOT rows or more, and at most HOT_VECTORS of them, are broadcast;
that many are all that can have rows / HOT_VECTORS rows each. All others are joined by their
bytes, and none of them is more than a HOT_VECTORS-th of the rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motioncheck.llm import shared

#: Components are multiplied by SCALE and rounded down.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: A vector with fewer rows is never hot; hot vectors at most, each of as many bytes as one vector has.
HOT, HOT_VECTORS = 10_000, 4096
LIMB = 48
#: Below this a row's sum of products is exact in doubles, and so is a distance, at most four times as much.
EXACT = 1 << 50
LONG = (1 << 63) - 1


def packed(batch: pa.RecordBatch, dimensions: int, scale: int) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (id, v): rows with a usable vector, quantised."""
    lists = batch.column(1)
    flat = lists.flatten()  # of the rows that aren't null, one after another
    sizes = np.diff(lists.offsets.to_numpy())
    whole = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (sizes == dimensions))
    if not len(whole):
        return
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    rows = values[starts[whole][:, None] + np.arange(dimensions)]
    with np.errstate(over="ignore", invalid="ignore"):
        rows = np.floor(rows * scale) + 0.0  # no negative zero
    usable = np.isfinite(rows).all(axis=1)
    rows, ids = rows[usable], batch.column(0).take(pa.array(whole[usable]))
    top = np.abs(rows).max(axis=1, initial=0)
    blocks = [b""] * len(rows)
    for kind, of in ((np.int16, top < 1 << 15), (np.int32, (top >= 1 << 15) & (top < 1 << 31)), (np.float64, top >= 1 << 31)):
        at = np.flatnonzero(of)
        for i, row in zip(at, rows[at].astype(kind)):
            blocks[i] = row.tobytes()
    yield pa.record_batch([ids, pa.array(blocks, pa.binary())], names=["id", "v"])


def unpacked(blocks: Sequence[bytes], dimensions: int) -> np.ndarray:
    """The vectors as doubles that are whole numbers, exactly."""
    out = np.empty((len(blocks), dimensions))
    kinds = np.fromiter((len(b) for b in blocks), np.int64, len(blocks))
    for kind in (np.int16, np.int32, np.float64):
        at = np.flatnonzero(kinds == dimensions * np.dtype(kind).itemsize)
        out[at] = np.frombuffer(b"".join(blocks[i] for i in at), kind).reshape(-1, dimensions)
    return out


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Each row's nearest centroid (ties: the smaller number) and the squared distance, exactly."""
    cluster, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
    most = math.isqrt(EXACT // rows.shape[1])
    small = (np.abs(rows).max(axis=1, initial=0) <= most) & all(abs(x) <= most for c in centroids for x in c)
    at = np.flatnonzero(small)
    if len(at):
        own, c = rows[at], np.array(centroids, np.float64)  # all below 2 ** 53
        all_of = np.einsum("ij,ij->i", own, own)[:, None] - 2 * (own @ c.T) + np.einsum("ij,ij->i", c, c)
        cluster[at] = all_of.argmin(axis=1)
        distance[at] = all_of[np.arange(len(at)), cluster[at]].astype(np.int64).tolist()
    for i in np.flatnonzero(~small):
        own = [int(x) for x in rows[i]]
        all_of = [sum((x - y) ** 2 for x, y in zip(own, c)) for c in centroids]
        distance[i] = min(all_of)
        cluster[i] = all_of.index(distance[i])
    return cluster, distance.tolist()


def limbs(value: int) -> list[int]:
    """value in digits of LIMB bits, the lowest first, all with its sign."""
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    while value or not out:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def sums(distinct: DataFrame, centroids: list[list[int]], dimensions: int, inertia: bool = False) -> list[list[int]]:
    """Per centroid: its rows, then the sum of each component over them (or of the distances alone), as exact integers."""
    width = 2 if inertia else dimensions + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * width for _ in centroids]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, weights = unpacked(batch.column(0).to_pylist(), dimensions), batch.column(1).to_numpy()
            cluster, distance = nearest(rows, centroids)
            for k in np.unique(cluster).tolist():
                own = np.flatnonzero(cluster == k)
                total[k][0] += int(weights[own].sum())
                if inertia:
                    total[k][1] += sum(distance[i] * int(weights[i]) for i in own)
                    continue
                exact = float(np.abs(rows[own]).max()) * float(weights[own].sum()) < 1 << 52
                added = weights[own].astype(np.float64) @ rows[own] if exact else [sum(int(x) * int(w) for x, w in zip(rows[own, j], weights[own])) for j in range(dimensions)]
                for j, x in enumerate(added):
                    total[k][j + 1] += int(x)
        out = [(k * width + j, i, x) for k, row in enumerate(total) if row[0] for j, value in enumerate(row) for i, x in enumerate(limbs(value))]
        if out:
            cell, limb, x = zip(*out)
            yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(limb, pa.int32()), pa.array(x, pa.int64())], names=["cell", "limb", "x"])

    found = distinct.select("v", "n").mapInArrow(partial, "cell int, limb int, x long").groupBy("cell", "limb").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    out = [[0] * width for _ in centroids]
    for r in found.collect():  # a few numbers per centroid and component
        out[r.cell // width][r.cell % width] += int(r.x) << (LIMB * r.limb)
    return out


def lloyd(distinct: DataFrame, centroids: list[list[int]], dimensions: int, rounds: int) -> list[list[int]]:
    """Centroids after so many rounds; a round that moves none is the last that needs work."""
    for _ in range(rounds):
        moved = [[x // n for x in total] if n else old for (n, *total), old in zip(sums(distinct, centroids, dimensions), centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def first_centroids(rows: DataFrame, clusters: int, seed: int, dimensions: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of `seed:id`; of repeated ids, the one with the smaller bytes first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.where("id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return [[int(x) for x in row] for row in unpacked([bytes(r.v) for r in found], dimensions)]


def _long(value: int) -> int | None:
    return value if value <= LONG else None


def cluster_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, hot: int = HOT
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row with a usable vector.

    A usable vector has exactly `dimensions` components, none of them null or non-finite (or beyond the
    range of doubles after scaling). Other rows have no result. Repeated ids and equal vectors are rows of their
    own, each counted. A row with a null id is assigned and counted, but no centroid starts from it. With fewer
    usable ids than `clusters`, so many centroids there are; without any, the result is empty. Equal first
    centroids stay apart by number: ties go to the smaller, the other stays as it is. distance,
    cluster_inertia and inertia are null where they don't fit into a long. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    schema = f"{id} {vectors.schema[id].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    kept = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shared.each(batches, lambda batch: packed(batch, dimensions, scale))

    rows = kept.mapInArrow(quantise, f"id {vectors.schema[id].dataType.simpleString()}, v binary")
    folder = shared.workspace(spark)
    distinct = shared.written(rows.groupBy("v").agg(F.count("*").alias("n")), f"{folder}/distinct")
    start = first_centroids(rows, clusters, seed, dimensions)
    if not start:
        return spark.createDataFrame([], schema)
    final = lloyd(distinct, start, dimensions, rounds)
    inertias = [x for _, x in sums(distinct, final, dimensions, inertia=True)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(unpacked(batch.column(0).to_pylist(), dimensions), final)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array([_long(x) for x in distance], pa.int64())], names=["of", "n", "cluster", "distance"])

    assigned = distinct.mapInArrow(assign, "of binary, n long, cluster int, distance long")
    joined = joined_back(rows, assigned, distinct, hot)
    of_cluster = lambda values, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)
    return joined.select(
        F.col("id").alias(id), "cluster", "distance", of_cluster(map(_long, inertias), "long").alias("cluster_inertia"), F.lit(_long(sum(inertias))).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256")
    )


def joined_back(rows: DataFrame, assigned: DataFrame, distinct: DataFrame, hot: int) -> DataFrame:
    """rows with their vector's assignment: the hottest vectors meet their rows without a shuffle."""
    total = distinct.agg(F.sum("n")).first()[0] or 0
    least = max(hot, -(-total // HOT_VECTORS))  # so at most HOT_VECTORS of them
    if not distinct.where(F.col("n") >= least).limit(1).count():
        return rows.join(assigned.drop("n"), F.col("v") == F.col("of"))
    few = assigned.where(F.col("n") >= least).drop("n")
    found = rows.join(F.broadcast(few), F.col("v") == F.col("of"), "left")
    met: Column = F.col("of").isNotNull()
    rest = found.where(~met).select("id", "v").join(assigned.where(F.col("n") < least).drop("n"), F.col("v") == F.col("of"))
    return found.where(met).union(rest)
