"""Language ID by segmentation-marginalised unigrams.

Method: a fixed public vocabulary of pieces; each language has a probability for each piece.
A word's probability in a language is the sum over all its segmentations into pieces, by a
forward algorithm; a text's is the product over its words. Piece probabilities are learned by
expectation maximisation over the same sums, on the whole texts of a bounded number of documents.

Words are scored once per worker and kept in a cache, all new ones of a batch together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.llm import shared
from motioncheck.llm.words import Chunk, WordTable, chunks

#: The bound of the sample that is learned from: documents per language; rounds of learning.
SAMPLE, ROUNDS = 400, 3
#: Longer words are scored one by one and in logarithms, as their probabilities are too small for the plain sums. The same sums.
LONG = 40
#: Positions of a long word whose pieces are looked up at once.
STRIP = 8192
#: A piece's weight before anything is counted, and the probability of an unknown character.
SMOOTHING, UNKNOWN = 0.05, 1e-7
#: Times the usual log probability of a character: what a word counts as at worst, and what a text may have at most.
WORST, UNUSUAL = 2.5, 1.7
#: Usual characters that are added to each text when its rate is taken.
FEW = 20
#: Words in a worker's cache; a full one is emptied.
CACHE = 500_000

_letter = re.compile(r"[^\W\d_]")
_gaps = re.compile("[ \t-\r]+")


class Pieces:
    """The vocabulary's pieces, found by a rolling hash of code points."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p})
        self.longest = max(map(len, self.pieces), default=1)
        codes = [np.array([_hash(p)], np.uint64) for p in self.pieces]
        keys = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order
        # a table by the hash's low bits says at once that most strings are no pieces
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.pieces)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each hash's piece, or -1."""
        out = np.full(len(keys), -1)
        maybe = np.flatnonzero(self.some[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        own = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        hit = self.keys[at] == own if len(self.keys) else np.zeros(len(own), bool)
        out[maybe[hit]] = self.number[at[hit]]
        return out


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = ((h ^ (ord(c) + 1)) * int(_MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


class Lattice:
    """All segmentations of some words: edges (word, from, to) -> piece, by the edge's end."""

    def __init__(self, words: list[str], pieces: Pieces):
        n, longest = len(words), max(map(len, words))
        self.size = np.array([len(w) for w in words])
        codes = np.zeros((n, longest), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(longest) < self.size[:, None]] = flat + np.uint64(1)
        self.ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(longest + 1)]
        for begin in range(longest):
            live = np.flatnonzero(self.size > begin)
            h = np.zeros(len(live), np.uint64)
            for length in range(1, min(pieces.longest, longest - begin) + 1):
                stay = self.size[live] >= begin + length
                live, h = live[stay], h[stay]
                if not len(live):
                    break
                h = (h ^ codes[live, begin + length - 1]) * _MULTIPLIER
                h ^= h >> np.uint64(29)
                found = pieces.find(h)
                if length == 1:
                    self.ends[begin + 1].append((begin, live, found))  # unknown characters are edges too
                else:
                    hit = found >= 0
                    if hit.any():
                        self.ends[begin + length].append((begin, live[hit], found[hit]))

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """(words, positions, languages): summed probability of the characters before each position; probability's last row is UNKNOWN."""
        alpha = np.zeros((len(self.size), len(self.ends), probability.shape[1]))
        alpha[:, 0] = 1
        for end, edges in enumerate(self.ends):
            for begin, live, piece in edges:
                alpha[live, end] += alpha[live, begin] * probability[piece]
        return alpha

    def expected(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by words that occur `counts` (words, languages) times."""
        alpha = self.forward(probability)
        beta = np.zeros_like(alpha)
        rows = np.arange(len(self.size))
        beta[rows, self.size] = 1
        for end in range(len(self.ends) - 1, 0, -1):
            for begin, live, piece in self.ends[end]:
                beta[live, begin] += beta[live, end] * probability[piece]
        weight = counts / alpha[rows, self.size]
        used = np.zeros_like(probability)
        for end, edges in enumerate(self.ends):
            for begin, live, piece in edges:
                np.add.at(used, piece, alpha[live, begin] * probability[piece] * beta[live, end] * weight[live])
        return used


class LongWord:
    """All segmentations of one word of any length; sums in logarithms, position after position."""

    def __init__(self, word: str, pieces: Pieces):
        self.codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n, self.pieces, self.longest = len(self.codes), pieces, pieces.longest

    def _strip(self, at: int, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From positions at to at + STRIP: [i, l], the piece of the l + 1 characters from there on (-1: none), and its log probabilities."""
        codes = self.codes[at : at + STRIP + self.longest - 1]
        rows = min(STRIP, self.n - at)
        found, h = np.full((rows, self.longest), -1, np.int32), np.zeros(rows, np.uint64)
        for length in range(self.longest):
            live = min(rows, len(codes) - length)
            if live <= 0:
                break
            h = (h[:live] ^ codes[length : length + live]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
            found[:live, length] = self.pieces.find(h)
        own = logs[found]
        own[:, 1:][found[:, 1:] < 0] = -np.inf  # a single character is an edge always
        return found, own

    def forward(self, logs: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log probability of the word per language; keep gets those of the characters before each position, in strips."""
        out = np.full((1 + self.longest, logs.shape[1]), -np.inf)
        out[0] = 0
        for at in range(0, self.n, STRIP):
            edges = self._strip(at, logs)[1]
            out = np.concatenate([out, np.full((len(edges), logs.shape[1]), -np.inf)])
            for i in range(len(edges)):
                to = out[i + 1 : i + 1 + self.longest]
                np.logaddexp(to, out[i] + edges[i], out=to)
            if keep is not None:
                keep.append(out[: len(edges)])
            out = out[len(edges) :]
        return out[0]

    def expected(self, logs: np.ndarray, counts: np.ndarray, used: np.ndarray) -> None:
        """Adds the expected uses of each piece by the word, which occurs `counts` (languages) times."""
        strips: list[np.ndarray] = []
        total = self.forward(logs, strips)
        after = np.full((1 + self.longest, logs.shape[1]), -np.inf)  # of this strip's end and later
        after[0] = 0
        for at, before in list(zip(range(0, self.n, STRIP), strips))[::-1]:
            piece, edges = self._strip(at, logs)
            after = np.concatenate([np.full((len(edges), logs.shape[1]), -np.inf), after])
            for i in range(len(edges) - 1, -1, -1):
                after[i] = np.logaddexp.reduce(after[i + 1 : i + 1 + self.longest] + edges[i], axis=0)
            for length in range(self.longest):
                use = np.exp(before + edges[:, length] + after[length + 1 : length + 1 + len(edges)] - total) * counts
                np.add.at(used, piece[:, length], use)
            after = after[: 1 + self.longest]


#: How the vocabulary marks a word's beginning, a fixed value.
MARK = "▁"


class Model:
    """Languages, pieces, and log probabilities of words."""

    def __init__(self, pieces: list[str]):
        self.pieces = Pieces(pieces)
        self.languages: list[str] = []
        self.probability = np.zeros((0, 0))
        self.usual = np.zeros(0)  # log probability of a character of the learned texts, per language

    def learn(self, counts: dict[str, Counter], rounds: int = ROUNDS) -> "Model":
        self.languages = sorted(counts)
        table: dict[str, np.ndarray] = {}
        for i, language in enumerate(self.languages):
            for word, n in counts[language].items():
                table.setdefault(MARK + word, np.zeros(len(self.languages)))[i] += n
        words = sorted((w for w in table if len(w) <= LONG), key=lambda w: (len(w), w))
        long = [(LongWord(w, self.pieces), table[w]) for w in sorted(table) if len(w) > LONG]
        groups = [words[i : i + 10_000] for i in range(0, len(words), 10_000)]  # a lattice is made anew each time, so only one is held
        k = len(self.pieces)
        p = np.full((k + 1, len(self.languages)), 1.0 / max(k, 1))
        p[k] = UNKNOWN
        for _ in range(rounds):
            used = sum((Lattice(g, self.pieces).expected(p, np.stack([table[w] for w in g])) for g in groups), np.zeros_like(p))
            logs = np.log(p)
            for word, n in long:
                word.expected(logs, n, used)
            p = used + SMOOTHING
            p[:k] /= p[:k].sum(axis=0)
            p[k] = UNKNOWN
        self.probability = p
        every = list(table)
        times, sizes = np.stack([table[w] for w in every]), np.array([len(w) for w in every])
        found = self.scores([w[len(MARK) :] for w in every])
        self.usual = (times * found).sum(axis=0) / (times * sizes[:, None]).sum(axis=0)
        return self

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word per language."""
        words = [MARK + w for w in words]
        out = np.zeros((len(words), len(self.languages)))
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], LONG, "right"))
        cuts = sorted({0, short, *np.searchsorted(sizes[order[:short]], [5, 8, 11, 15, 20, 28]).tolist(), *range(0, short, 16384)})
        for a, b in zip(cuts, cuts[1:]):  # words of about one length together
            own = order[a:b]
            lattice = Lattice([words[i] for i in own.tolist()], self.pieces)
            out[own] = np.log(lattice.forward(self.probability)[np.arange(len(own)), lattice.size])
        logs = np.log(self.probability) if short < len(words) else None
        for i in order[short:].tolist():
            out[i] = LongWord(words[i], self.pieces).forward(logs)
        return out


class Scorer:
    """A worker's cache of words: the score per language, then the length."""

    def __init__(self, model: Model):
        self.model, self.rows = model, WordTable(CACHE)
        self.table = np.zeros((CACHE, len(model.languages) + 1))

    def _new(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.model.scores(words), np.array([len(w) + len(MARK) for w in words], float)[:, None]], axis=1)

    def of(self, chunk: Chunk) -> np.ndarray:
        """Each word's row."""
        at = self.rows.find(chunk.hashes)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.table[at]
        new, first, back = np.unique(chunk.hashes[missing], return_index=True, return_inverse=True)
        raw = chunk.raw
        found = self._new([raw[chunk.starts[i] : chunk.ends[i]].tobytes().decode("utf-8", "replace").lower() for i in missing[first].tolist()])
        out = self.table[at]
        out[missing] = found[back]
        if self.rows.size + len(new) > CACHE:
            self.rows.clear()
        if len(new) <= CACHE:
            self.table[self.rows.size : self.rows.size + len(new)] = found
            self.rows.add(new)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float], list[float | None]]:
        """Of each text: language, its posterior, and its rate (see identify())."""
        languages, scores, rates = [], [], []
        k = len(self.model.languages)
        for chunk in chunks(texts, lower=True):
            if k:
                words = self.of(chunk)
                sums = lambda x: np.diff(np.append(0.0, np.cumsum(x))[chunk.first])  # noqa: B023, E731  of each document
                total = np.stack([sums(words[:, j]) for j in range(k)], axis=1)
                bounded = np.stack([sums(np.maximum(words[:, j], WORST * self.model.usual[j] * words[:, k])) for j in range(k)], axis=1)
                best = total.argmax(axis=1)
                row = np.arange(chunk.docs)
                sure = 1 / np.exp(total - total[row, best][:, None]).sum(axis=1)
                usual = self.model.usual[best]
                rate = (bounded[row, best] + FEW * usual) / ((sums(words[:, k]) + FEW) * usual)
            for d in range(chunk.docs):
                text = texts[chunk.row + d].as_py()
                if not text or not k or not _letter.search(text):
                    languages.append("und")
                    scores.append(0.0)
                    rates.append(None)
                else:
                    languages.append(self.model.languages[best[d]])
                    scores.append(float(sure[d]))
                    rates.append(float(rate[d]))
        return languages, scores, rates


def default_pieces() -> list[str]:
    """The pieces of a public vocabulary, with its mark of a word's beginning."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as the empty text's 0."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns from the whole texts of about `sample` documents of each language: those of the least hashes of the id.

    Documents that are held out, and null texts, languages and ids, are not learned from. Rows
    that repeat an id are in the sample or out of it together. No texts are shuffled or sent to
    the driver: tasks count the sampled documents' words, and the sums come.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id)))
    keyed = known.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(id), F.lit(3)).alias("h"), F.col(text).alias("text"))
    sizes = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language, as the model has; no text is read
    model = Model(pieces)
    # a share of the hashes' range that holds the sample almost surely, in one pass over the texts; more where many are null
    shares = {k: 1.5 * sample / n + 10 / n for k, n in sizes.items()}
    folder, near = shared.workspace(spark), None
    hashes: dict[str, list[int]] = {}
    todo, step = set(shares), 0
    while todo:
        limits = spark.createDataFrame([(k, int(-(2**63) + min(1.0, shares[k]) * (2.0**64 - 2**12))) for k in todo], "own string, near long")
        some = keyed.join(F.broadcast(limits), (F.col("lang") == F.col("own")) & (F.col("h") <= F.col("near"))).where(F.col("text").isNotNull()).select("lang", "h", "text")
        some = shared.written(some, f"{folder}/near-{step}")
        own: dict[str, list[int]] = {}
        for row in some.select("lang", "h").collect():  # about 1.5 samples a language, four times as many where texts are null
            own.setdefault(row.lang, []).append(row.h)
        done = {k for k in todo if len(own.get(k, [])) >= sample or shares[k] >= 1}
        hashes.update({k: sorted(own[k]) for k in done if k in own})
        some = some.where(F.col("lang").isin(*done))
        near = some if near is None else near.union(some)
        todo, step = todo - done, step + 1
        shares.update({k: shares[k] * 4 for k in todo})
    if not hashes:
        return model
    limits = spark.createDataFrame([(k, h[:sample][-1]) for k, h in hashes.items()], "own string, most long")
    chosen = near.join(F.broadcast(limits), (F.col("lang") == F.col("own")) & (F.col("h") <= F.col("most"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: Counter = Counter()
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own.update((language, w) for w in _gaps.split(text.as_py().lower()) if w)
            if own:
                languages, words = zip(*own)
                yield pa.record_batch([pa.array(languages), pa.array(words), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, Counter] = {k: Counter() for k in hashes}
    for row in chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        counts[row.lang][row.word] = row.n
    return model.learn(counts)


_scorers: dict[int, Scorer] = {}


def _scorer(key: int, model: Broadcast) -> Scorer:
    """This worker's scorer of a model."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model.value)
    return _scorers[key]


def _key(model: Model) -> int:
    return zlib.crc32(model.probability.tobytes()) ^ len(model.languages)


def identify(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rate) per row of docs; only the text is looked at.

    score is the posterior probability of the language among the learned ones. rate tells how
    usual the text is in that language: its log probability a character over that of learned
    texts. 1 is usual, other languages and junk are higher; no word counts as worse than WORST,
    and FEW usual characters are added, so that short texts need more to be unusual. Null text
    and text without letters is `und` with score 0 and null rate, as is every text if nothing
    was learned. Whole texts count, of any length. Ties go to the first language in order. Rows that
    repeat an id are rows of their own; other columns are ignored, whatever their names; no
    rows make no rows.
    """
    held, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                languages, scores, rates = _scorer(key, held).predict(part.column(2))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "rate"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rate double")


def in_learned_languages(docs: DataFrame, model: Model, text: str = "text", limit: float = UNUSUAL) -> DataFrame:
    """The rows of docs whose text has a rate (see identify()) of `limit` at most, with all columns as they are: a pass with no shuffle.

    `und` is left out: null, empty and letterless texts, and all if nothing was learned.
    """
    held, key = docs.sparkSession.sparkContext.broadcast(model), _key(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = _scorer(key, held).predict(batch.column(text))[2]
            yield batch.filter(pa.array([r is not None and r <= limit for r in rates], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text is in a language that `lang` of these documents teaches.

    Rejects by the rate, not by the posterior, which is high for one of the learned languages
    whatever the text. Null, empty and letterless texts go; repeated rows each count; null ids
    and languages are judged but not learned from; all columns stay as they are; no rows make no rows.
    """
    shared.ready(spark)
    return in_learned_languages(docs, fit(docs, default_pieces()))
