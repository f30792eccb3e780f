"""Approximate nearest neighbours by cosine.

Method: low-dimensional stable projections indexed by kd-trees. Unit vectors are projected on
a few Gaussian directions; of two vectors at distance d, the squared projected distance is
d * d times a chi-square variable. A query takes its neighbours one after another by their
projected distance and verifies them on the original vectors, until the chi-square test says
that a row further out would beat its k-th neighbour with a probability below 1 - CONFIDENCE.

The tree is spread over the cluster: its upper levels, fitted on a bounded sample, cut the
projected space into cells of about CELL rows, and each cell's rows are indexed in its task. A
query goes to its own cell first. What it finds there bounds the distance, and it goes on only
to those cells whose box the test doesn't rule out. A cell with far more rows than others is
indexed in parts, and its queries go to each of them. So rows are shuffled to their cell twice,
whatever the number of queries, and queries to the cells they reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from motioncheck.llm import shared

DIMENSIONS = 16
CONFIDENCE = 0.95
#: Rows in a leaf and in a cell, about; cells at most (their boxes are in every task); queries that a cell takes in one task, about.
LEAF, CELL, CELLS, BLOCK = 64, 12_000, 1 << 16, 50_000
#: Rows that the cells are fitted on, about: so many, or so many a cell where that is more.
SAMPLE, SAMPLE_CELL = 20_000, 4
#: Cells' worth of rows that one index has, about; a larger cell is indexed in parts.
PARTED = 4


def chi_square(x: float, m: int) -> float:
    """P(chi-square with m degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, x = m / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > total * 1e-15:
        term *= x / (a + n)
        total += term
        n += 1
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def directions(n: int, m: int, seed: int) -> np.ndarray:
    """The projections of vectors of a length, the same in every task."""
    return np.random.default_rng([seed, n]).standard_normal((n, m))


def projected(rows: np.ndarray, on: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None] @ on


def gaps(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The least squared distance of a point to each box."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


class Cells:
    """The upper levels of a kd-tree: 2 ** depth boxes that fill the space."""

    def __init__(self, sample: np.ndarray, depth: int, m: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        self.low, self.high = np.full((1 << depth, m), -np.inf), np.full((1 << depth, m), np.inf)
        todo = [(1, 0, sample)]
        while todo:  # node x has the children 2x and 2x + 1; the cells are the last level in order
            node, level, own = todo.pop()
            if level == depth:
                continue
            axis = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            span, first = 1 << (depth - level - 1), node * (1 << (depth - level)) - (1 << depth)
            self.high[first : first + span, axis] = cut
            self.low[first + span : first + 2 * span, axis] = cut
            left = own[:, axis] <= cut
            todo += [(2 * node, level + 1, own[left]), (2 * node + 1, level + 1, own[~left])]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


class Index:
    """A cell's rows in a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, on: np.ndarray):
        points, todo, leaves = projected(rows, on), [np.arange(len(rows))], []
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            wide = int(np.ptp(points[own], axis=0).argmax())
            own = own[np.argpartition(points[own, wide], len(own) // 2)]
            todo += [own[: len(own) // 2], own[len(own) // 2 :]]
        order = np.concatenate(leaves)
        self.ids, self.rows, self.points = ids[order], rows[order], points[order]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.rows, self.rows))
        self.cut = np.cumsum([0, *map(len, leaves)])
        self.low = np.array([points[l].min(axis=0) for l in leaves])
        self.high = np.array([points[l].max(axis=0) for l in leaves])
        self.verified = 0

    def incremental(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Rows by projected distance: (no row that comes later is nearer than this, rows, their squared distances)."""
        far = gaps(self.low, self.high, point)
        leaves = np.argsort(far, kind="stable")
        wait, away = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 1
        while at < len(leaves) or len(wait):
            own = [np.arange(self.cut[l], self.cut[l + 1]) for l in leaves[at : at + step]]
            at, step = at + step, min(32, step * 2)
            if own:
                new = np.concatenate(own)
                gap = self.points[new] - point
                wait, away = np.concatenate([wait, new]), np.concatenate([away, np.einsum("ij,ij->i", gap, gap)])
            until = far[leaves[at]] if at < len(leaves) else math.inf
            near = away <= until
            if near.any():
                order = np.argsort(away[near], kind="stable")
                yield until, wait[near][order], away[near][order]
                wait, away = wait[~near], away[~near]

    def search(self, query: np.ndarray, point: np.ndarray, k: int, test: float, bound: float = -2.0) -> list[tuple[float, int]]:
        """(-cosine, id) of the k nearest distinct ids, none below the bound, ties to smaller ids."""
        norm = math.sqrt(float(np.einsum("i,i->", query, query)))
        best: list[tuple[float, int]] = []
        worst, step = bound, 32
        for until, rows, away in self.incremental(point):
            at = 0
            while at < len(rows):
                if away[at] > test * max(0.0, 2 - 2 * worst):
                    return best
                own = rows[at : at + step]
                at, step = at + step, min(512, step * 2)
                self.verified += len(own)
                # each row on its own, so that equal rows have equal values
                found = np.einsum("ij,j->i", self.rows[own], query) / (self.norms[own] * norm)
                take = np.flatnonzero(found >= worst)
                if len(take) > 4 * k:  # of many, only the k nearest ids can matter; an id may have several vectors
                    least = np.sort(found[take])[-4 * k]
                    if len(np.unique(self.ids[own[take[found[take] >= least]]])) >= k:
                        take = take[found[take] >= least]
                if len(take):
                    by: dict[int, float] = {i: x for x, i in best}
                    for x, i in zip((-found[take]).tolist(), self.ids[own[take]].tolist()):
                        by[i] = min(x, by.get(i, math.inf))
                    best = sorted((x, i) for i, x in by.items())[:k]
                    if len(best) == k:
                        worst = max(worst, -best[-1][0])
            if until > test * max(0.0, 2 - 2 * worst):
                return best
        return best


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): rows whose vectors are neither null, empty or zero, nor hold null or non-finite components."""
    kind = df.schema[vector].dataType
    v = F.col(vector) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    inf = F.lit(float("inf"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == inf))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors in a column: length, rows, matrix."""
    sizes = np.diff(vectors.offsets.to_numpy())
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


CELL_ROWS = "n int, cell int, id long, v array<double>"
ASKED = "n int, cell int, key long, bound double, v array<double>"


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _run(batches: Iterator[pa.RecordBatch], k: int, test: float, m: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (n, cell, block, query, key, bound, v) by cell and block, a cell's own before its queries, to (key, id, score)."""
    at, parts, index, on = None, [], None, None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        asked = batch.column(3).to_numpy(zero_copy_only=False)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (asked[1:] != asked[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            if a == b:
                continue
            own = tuple(keys[a].tolist())
            if own != at:
                at, parts, index, on = own, [], None, directions(own[0], m, seed)
            part = batch.slice(a, b - a)
            ids, rows = part.column(4).to_numpy(), part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, own[0])
            if not asked[a]:
                parts.append((ids, rows))
                continue
            if index is None:
                if not parts:
                    continue
                index = Index(*(np.concatenate(x) for x in zip(*parts)), on)
                parts = []
            bounds = part.column(5).fill_null(-2.0).to_numpy()
            found = [(key, i, -x) for key, row, point, bound in zip(ids.tolist(), rows, projected(rows, on), bounds.tolist()) for x, i in index.search(row, point, k, test, bound)]
            if found:
                key, i, x = zip(*found)
                yield pa.record_batch([pa.array(key, pa.int64()), pa.array(i, pa.int64()), pa.array(x, pa.float64())], names=["key", "id", "score"])


def nearest(df: DataFrame, every: int = 50, k: int = 5, id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row whose id is divisible by `every`.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; nor
    do null ids. Vectors of other lengths are only compared among themselves. Rows that repeat
    an id are one candidate, with the largest cosine of its vectors, and one query, with the
    largest cosine of any of its vectors; a query never finds its own id. Of equal vectors, as
    many ids as can be an answer are kept, before anything else, so a vector may have any number
    of rows. Other columns are ignored, whatever their names; no rows make no rows; few rows make
    shorter lists. Ties go to smaller ids.
    """
    spark = df.sparkSession
    folder = shared.workspace(spark)
    m, test = dimensions, quantile(confidence, dimensions)
    rows = usable(df, id, vector).distinct()
    # a row's own id is an answer too until the end, so k + 1 are needed
    one = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = shared.written(rows.withColumn("one", one).where(F.col("one") <= k + 1).drop("one"), f"{folder}/points")
    asked = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    queries = shared.written(asked.select("v").distinct().withColumn("key", F.monotonically_increasing_id()), f"{folder}/queries")
    whose = shared.written(asked.join(queries, "v").select("key", F.col("id").alias("query_id")), f"{folder}/whose")

    sizes = {r.n: r["count"] for r in points.groupBy(F.size("v").alias("n")).count().collect()}  # a row per length
    total = max(1, sum(sizes.values()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, own in _matrices(batch.column(0)):
                yield pa.record_batch([pa.array(np.full(len(own), n, np.int32)), _lists(projected(own, directions(n, m, seed)))], names=["n", "p"])

    depths = {n: max(0, math.ceil(math.log2(min(CELLS, max(1, count / CELL))))) for n, count in sizes.items()}
    rate = min(1.0, max(SAMPLE, SAMPLE_CELL * sum(1 << d for d in depths.values())) / total)
    some = points.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) <= int(rate * (1 << 30))).select("v")
    sample: dict[int, list] = {}
    # of DIMENSIONS numbers each, and SAMPLE or SAMPLE_CELL * CELLS rows at most
    for batch in some.mapInArrow(sketch, "n int, p array<double>").toArrow().to_batches():
        lengths, own = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, m)
        for n in np.unique(lengths).tolist():
            sample.setdefault(n, []).append(own[lengths == n])
    trees = {}
    for n, depth in depths.items():
        own = np.concatenate(sample.get(n, [np.zeros((0, m))]))
        trees[n] = Cells(own, depth if len(own) else 0, m)
    cells = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, own in _matrices(batch.column(1)):
                cell = cells.value[n].of(projected(own, directions(n, m, seed)))
                yield pa.record_batch([pa.array(np.full(len(own), n, np.int32)), pa.array(cell, pa.int32()), batch.column(0).take(pa.array(at)), _lists(own)], names=["n", "cell", "id", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, bound, v) to the cells other than the own one that the test leaves."""
        for batch in batches:
            for n, at, own in _matrices(batch.column(2)):
                tree, keys, bounds = cells.value[n], batch.column(0).to_numpy()[at], batch.column(1).fill_null(-2.0).to_numpy()[at]
                where = projected(own, directions(n, m, seed))
                home = tree.of(where)
                for i in range(len(own)):
                    left = gaps(tree.low, tree.high, where[i]) <= test * max(0.0, 2 - 2 * bounds[i])
                    left[home[i]] = False
                    to = np.flatnonzero(left)
                    if len(to):
                        yield pa.record_batch([pa.array(np.full(len(to), n, np.int32)), pa.array(to, pa.int32()), pa.array(np.full(len(to), keys[i])), pa.array(np.full(len(to), bounds[i])), _lists(np.repeat(own[i : i + 1], len(to), axis=0))], names=["n", "cell", "key", "bound", "v"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, own in _matrices(batch.column(0)):
                cell, rows = np.unique(cells.value[n].of(projected(own, directions(n, m, seed))), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(cell), n, np.int32)), pa.array(cell, pa.int32()), pa.array(rows, pa.int64())], names=["n", "cell", "rows"])

    placed = points.mapInArrow(place, CELL_ROWS)
    held = points.select("v").mapInArrow(tally, "n int, cell int, rows long").groupBy("n", "cell").agg(F.ceil(F.sum("rows") / (PARTED * CELL)).cast("int").alias("parts"))
    held = shared.written(held, f"{folder}/held")  # a row per cell

    def searched(routed: DataFrame) -> DataFrame:
        """(key, id, score) of what queries find in the cells they are routed to."""
        # a cell that very many queries reach, or that has very many rows, is in several tasks; one that none reaches isn't shuffled
        blocks = routed.groupBy("n", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(held, ["n", "cell"])
        part, block = (F.pmod(F.xxhash64(key), F.col(of)).cast("int") for key, of in (("id", "parts"), ("key", "blocks")))
        all_of = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
        own = placed.join(blocks, ["n", "cell"]).select("n", "cell", F.explode(F.transform(all_of("blocks"), lambda b: part * F.col("blocks") + b)).alias("block"), F.lit(False).alias("query"), F.col("id").alias("key"), F.lit(None).cast("double").alias("bound"), "v")
        some = routed.join(blocks, ["n", "cell"]).select("n", "cell", F.explode(F.transform(all_of("parts"), lambda p: p * F.col("blocks") + block)).alias("block"), F.lit(True).alias("query"), "key", "bound", "v")
        both = own.union(some).repartition(shared.shuffle_partitions(spark), "n", "cell", "block").sortWithinPartitions("n", "cell", "block", "query")
        return both.mapInArrow(lambda batches: _run(batches, k + 1, test, m, seed), "key long, id long, score double")

    home = queries.select(F.col("key").alias("id"), "v").mapInArrow(place, CELL_ROWS).select("n", "cell", F.col("id").alias("key"), F.lit(None).cast("double").alias("bound"), "v")
    first = shared.written(searched(home), f"{folder}/first")
    # the score of the k + 1st that a cell's parts found; null if there are fewer
    bounds = first.groupBy("key").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), k).alias("bound"))
    on = shared.written(queries.join(bounds, "key").select("key", "bound", "v").mapInArrow(route, ASKED), f"{folder}/routed")
    found = first.union(searched(on)).groupBy("key", "id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    found = found.withColumn("best", best).where(F.col("best") <= k + 1).drop("best")
    # rows that are queries with the same vector share what it found
    own = whose.join(found, "key").where("query_id <> id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
