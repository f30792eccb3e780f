"""Toxicity by classifier chains.

Method: categories are predicted one after another by linear models on the words of a text;
each later model also takes the probabilities of earlier categories. It is trained with
out-of-fold probabilities of those, so that it sees them as wrong as they will be. Tasks count
the words of a bounded number of labelled documents; models are fitted on the driver from the
words that go with a category; predicting is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.llm import shared, words
from motioncheck.llm.decontam import PLAIN

#: The bound of the sample: labelled documents, with all of their words.
SAMPLE = 12_000
#: Folds; words that chance alone would choose, at most.
FOLDS, CHANCE = 5, 0.05
#: The ridge, and the rounds of fitting.
RIDGE, ROUNDS = 0.1, 60
#: A document is flagged at this probability of the last category.
LIMIT = 0.5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def word_sets(texts: pa.Array) -> Iterator[tuple[words.Chunk, np.ndarray, np.ndarray]]:
    """For each chunk: chunk, and the distinct (document, word hash) pairs, by document."""
    for chunk in words.chunks(texts, lower=True, white=PLAIN):
        doc = chunk.doc_of_word()
        order = np.lexsort((chunk.hashes, doc))
        doc, own = doc[order], chunk.hashes[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])]) if len(own) else np.zeros(0, bool)
        yield chunk, doc[new], own[new]


@dataclass
class Chain:
    """A linear model per category: a word table with a column of weights each, and weights of earlier categories."""

    categories: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    earlier: np.ndarray
    some: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """(documents, categories) from each document's summed word weights."""
        out = np.zeros_like(sums)
        for c in range(len(self.categories)):
            out[:, c] = sigmoid(self.bias[c] + sums[:, c] + out[:, :c] @ self.earlier[c, :c])
        return out

    def predict(self, texts: pa.Array) -> np.ndarray:
        parts = [np.zeros((0, len(self.categories)))]
        for chunk in words.chunks(texts, lower=True, white=PLAIN):
            sums = np.zeros((chunk.docs, len(self.categories)))
            maybe = np.flatnonzero(self.some[(chunk.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(self.words) and len(maybe):
                own = chunk.hashes[maybe]
                at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
                hit = self.words[at] == own
                # a word counts once in a document
                pairs = words.distinct(chunk.doc_of_word()[maybe[hit]] * len(self.words) + at[hit])
                np.add.at(sums, pairs // len(self.words), self.weights[pairs % len(self.words)])
            parts.append(self.probabilities(sums))
        return np.concatenate(parts)


def associated(seen: np.ndarray, both: np.ndarray, share_of_all: float, n_words: int) -> np.ndarray:
    """Which words' documents have a share of the category so far from the whole's that chance makes CHANCE such among n_words.

    seen: a word's documents; both: those in the category. Chance by Chernoff's bound of the
    binomial tail, so rare words need no rule of their own.
    """
    q = min(max(share_of_all, 1e-6), 1 - 1e-6)
    share = both / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(share > 0, share * np.log(share / q), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - q)), 0)
    return seen * far > np.log(max(1, n_words) / CHANCE)


@dataclass
class Sparse:
    """A matrix of 0 and 1, by the rows and columns of the ones, with some dense columns and one of ones beside it."""

    rows: np.ndarray
    columns: np.ndarray
    shape: tuple[int, int]
    dense: np.ndarray

    def __post_init__(self) -> None:
        self.dense = np.concatenate([self.dense, np.ones((self.shape[0], 1))], axis=1)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.columns], minlength=self.shape[0]) + self.dense @ w[self.shape[1] :]

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.columns, weights=v[self.rows], minlength=self.shape[1]), self.dense.T @ v])

    def squares(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.columns, weights=v[self.rows], minlength=self.shape[1]), (self.dense * self.dense).T @ v])


def fit_linear(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression: weights of x's columns. Newton's steps by conjugate gradients; the bias has next to no ridge."""
    size = x.shape[1] + x.dense.shape[1]
    w, ridge = np.zeros(size), np.full(size, RIDGE)
    ridge[-1] = 1e-3
    for _ in range(ROUNDS):
        p = sigmoid(x.times(w))
        gradient = x.transposed_times(p - y) + ridge * w
        if np.abs(gradient).max() < 1e-6:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        scale = x.squares(curve) + ridge
        step, left = np.zeros(size), gradient.copy()
        z = left / scale
        way, power = z.copy(), left @ z
        for _ in range(200):
            turned = x.transposed_times(curve * x.times(way)) + ridge * way
            far = power / (way @ turned)
            step += far * way
            left -= far * turned
            if np.abs(left).max() < 1e-3 * np.abs(gradient).max() + 1e-9:
                break
            z = left / scale
            power, before = left @ z, power
            way = z + power / before * way
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w


def fit_chain(rows: np.ndarray, columns: np.ndarray, table: np.ndarray, chosen: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: list[str]) -> Chain:
    """(document, word) pairs; the words' hashes; [category, fold, word]: the words that a model takes, without that fold's documents (the last: with all); labels (documents, categories), nan where unknown."""
    n, many = labels.shape
    weights = np.zeros((len(table), many))
    bias, earlier = np.full(many, -35.0), np.zeros((many, many))
    before = np.zeros((n, 0))
    for c in range(many):
        y = labels[:, c]
        known = ~np.isnan(y)
        out = np.zeros(n)
        for f in range(FOLDS + 1):
            use = known & (folds != f)  # no document is in the last fold: the model itself
            take = np.flatnonzero(chosen[c, f])
            w, last = np.zeros(len(table)), np.zeros(c + 1)
            last[-1] = -35.0
            if use.any():
                where = np.full(len(table), -1)
                where[take] = np.arange(len(take))
                own = use[rows] & (where[columns] >= 0)
                found = fit_linear(Sparse((np.cumsum(use) - 1)[rows[own]], where[columns[own]], (int(use.sum()), len(take)), before[use]), y[use])
                w[take], last = found[: len(take)], found[len(take) :]
            if f < FOLDS:  # what a later model is trained with
                on = folds == f
                sums = np.bincount(rows, weights=w[columns], minlength=n)
                out[on] = sigmoid(sums + before @ last[:-1] + last[-1])[on]
            else:
                weights[:, c], earlier[c, :c], bias[c] = w, last[:-1], last[-1]
        before = np.concatenate([before, out[:, None]], axis=1)
    used = np.flatnonzero(weights.any(axis=1))
    return Chain(categories, table[used], weights[used], bias, earlier)


def fold_of(ids: np.ndarray) -> np.ndarray:
    return (words.mix(ids.view(np.uint64)) % np.uint64(FOLDS)).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str = "text", id: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """A chain for categories (name -> 0/1 column of labels, in the chain's order).

    Learns from the whole texts of `sample` labelled ids at most, those of the least hashes: a
    set whose broadcast that parameter bounds. An id's labels are the largest of its rows'; null
    ones are not learned from. Words are counted by tasks; those that go with a category come to
    the driver, and the documents' share of them.
    """
    spark = docs.sparkSession
    folder = shared.workspace(spark)
    names = [f"_{i}" for i in range(len(categories))]
    marks = labels.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("_id"), *[c.cast("int").alias(x) for x, c in zip(names, categories.values())])
    marks = marks.groupBy("_id").agg(*[F.max(x).alias(x) for x in names]).withColumn("_h", F.xxhash64("_id", F.lit(5)))
    n = marks.count()
    limit = int(-(2**63) + min(1.0, 1.2 * sample / max(1, n) + 200 / max(1, n)) * (2.0**64 - 2**12))
    chosen = marks.where(F.col("_h") <= limit).orderBy("_h", "_id").limit(sample).drop("_h")
    own = docs.select(F.col(id).cast("long").alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, doc, hashes in word_sets(batch.column(1)):
                cuts = np.searchsorted(doc, np.arange(chunk.docs + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64)))
                part = batch.slice(chunk.row, chunk.docs)
                fold = fold_of(part.column(0).to_numpy())
                yield pa.record_batch([part.column(0), pa.array(fold), lists, *part.columns[2:]], names=["_doc", "_fold", "_words", *batch.schema.names[2:]])

    kinds = "_doc long, _fold int, _words array<long>, " + ", ".join(f"{x} int" for x in names)
    sampled = shared.written(own.select("_doc", "_text", *names).mapInArrow(gather, kinds), f"{folder}/sampled")
    cells = [(x, f) for x in names for f in range(FOLDS)]
    # per category and fold: documents with a label, and those in the category
    within = lambda x, f, v: F.sum(F.when(F.col("_fold") == f, v)).cast("double")
    sums = [F.coalesce(within(x, f, v), F.lit(0.0)).alias(f"{kind}{x}_{f}") for x, f in cells for kind, v in (("n", F.col(x).isNotNull().cast("int")), ("k", F.col(x)))]
    counts = shared.written(sampled.select(F.explode("_words").alias("word"), "_fold", *names).groupBy("word").agg(*sums), f"{folder}/counts")
    whole = sampled.agg(*sums).first().asDict()
    others = lambda kind, x, f: [f"{kind}{x}_{g}" for g in range(FOLDS) if g != f]
    models = [(x, f) for x in names for f in range(FOLDS + 1)]  # of the last, no fold is left out
    seen = counts.agg(*[F.count_if(sum(map(F.col, others("n", x, f))) > 0).alias(f"{x}_{f}") for x, f in models]).first().asDict()
    shares = {m: sum(whole[c] for c in others("k", *m)) / max(1.0, sum(whole[c] for c in others("n", *m))) for m in models}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            found = np.zeros(batch.num_rows, np.int64)
            for i, (x, f) in enumerate(models):
                found |= associated(sum(own[c] for c in others("n", x, f)), sum(own[c] for c in others("k", x, f)), shares[x, f], seen[f"{x}_{f}"]).astype(np.int64) << i
            keep = pa.array(found != 0)
            yield pa.record_batch([batch.column("word").filter(keep), pa.array(found).filter(keep)], names=["word", "models"])

    picked = counts.mapInArrow(choose, "word long, models long").collect()  # the words that go with a category
    table = np.array(sorted(np.int64(r.word).view(np.uint64) for r in picked), np.uint64)
    takes = np.zeros((len(names), FOLDS + 1, len(table)), bool)
    for r in picked:
        at = int(np.searchsorted(table, np.int64(r.word).view(np.uint64)))
        for i in range(len(models)):
            takes[i // (FOLDS + 1), i % (FOLDS + 1), at] = r.models >> i & 1
    held = spark.sparkContext.broadcast(table)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, found = batch.column(2), []
            for own in lists:
                own = own.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(held.value, own), max(0, len(held.value) - 1))
                found.append(at[held.value[at] == own].astype(np.int32) if len(held.value) else at[:0].astype(np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), *batch.columns[3:]], names=batch.schema.names)

    rows = sampled.mapInArrow(restrict, kinds.replace("array<long>", "array<int>")).collect()
    rows.sort(key=lambda r: (r._doc, r._words))
    y = np.array([[np.nan if r[x] is None else r[x] for x in names] for r in rows], float).reshape(len(rows), len(names))
    pairs = [np.array(r._words, np.int64) for r in rows]
    return fit_chain(np.repeat(np.arange(len(rows)), [len(p) for p in pairs]) if rows else np.zeros(0, np.int64), np.concatenate(pairs) if rows else np.zeros(0, np.int64), table, takes, y, np.array([r._fold for r in rows], np.int32), list(categories))


def classify(docs: DataFrame, chain: Chain, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, p_<category>...) per row of docs.

    Words are runs of characters that are neither white space nor ASCII punctuation, A-Z
    lower-cased; each counts once in a text. Null and empty texts have no words and get the
    chain's base rates. Rows that repeat an id are rows of their own; other columns are ignored, whatever
    their names; no rows make no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.predict(batch.column(1))
            yield pa.record_batch([batch.column(0), *(pa.array(p[:, c]) for c in range(len(names)))], names=["doc_id", *names])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in names))


def toxic_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic) of the documents that the chain low quality -> toxic flags as toxic.

    Null labels aren't learned from, and of labels that repeat an id the largest count. Null and
    empty texts have the base rates; rows that repeat an id, or have none, are judged on their
    own. Without labels, or where the sample has no toxic document, none is flagged; no rows make no rows.
    """
    chain = fit(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return classify(docs, chain).where(F.col("p_toxic") >= LIMIT)
