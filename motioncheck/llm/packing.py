"""Sequence packing: documents' tokens in windows of one size, with little padding.

Method: sum-of-squares online packing. Of the windows that are partly filled, a level array
counts how many have each fill. A document goes to the fill level that leaves the least sum
of squared counts, or to a new window where that is least. Longer documents first fill whole
windows. Every task packs its own documents as they come; what is open at its end is joined,
cut into whole windows, and the rest into windows whose lengths are powers of two, which take
no padding. No shuffle is needed. A task holds the ids of the pieces in its open windows, four
bytes a token: at most those of its own partition, a split of spark.sql.files.maxPartitionBytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.llm.tokens import words_of

WINDOW = 2048
#: The id that ends a document.
END = 1
#: Texts that are encoded at once.
BATCH = 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces; rows() gives those whose window is closed.

    A piece is (document, start, ids as bytes, the document's tokens).
    """

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.closed: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, at, ids))
            at += len(ids) // 4
        self.sequence += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.window
        for at in range(0, whole, self.window):
            self._close([(doc, at, ids[4 * at : 4 * (at + self.window)], total)])
        size = total - whole
        if size:
            self._place((doc, whole, ids[4 * whole :], total), size)

    def _place(self, piece: tuple, size: int) -> None:
        count = self.count
        # the sum's change, by the level that takes the piece: it loses one there, and gains one above
        gain = 2 * count[size:] + 1
        gain[-1] = 0
        gain[1:] += np.where(count[1 : self.window - size + 1] > 0, 1 - 2 * count[1 : self.window - size + 1], 1 << 40)
        level = int(gain.argmin())
        pieces = self.open[level].pop() if level else []
        count[level] -= level > 0
        pieces.append(piece)
        if level + size == self.window:
            self._close(pieces)
        else:
            count[level + size] += 1
            self.open[level + size].append(pieces)

    def finish(self) -> None:
        """Joins the open windows' pieces, fullest first, and cuts them into closed windows."""
        room, pieces, left = self.window, [], [p for level in self.open[::-1] for window in level for p in window]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        rest = sum(len(p[2]) for p in left) // 4
        for doc, start, ids, total in left:
            while ids:
                if not pieces:
                    room = self.window if rest >= self.window else 1 << (rest.bit_length() - 1)
                part, ids = ids[: 4 * room], ids[4 * room :]
                pieces.append((doc, start, part, total))
                start += len(part) // 4
                room -= len(part) // 4
                rest -= len(part) // 4
                if not room:
                    self._close(pieces)
                    pieces = []

    def rows(self) -> list[tuple]:
        out, self.closed = self.closed, []
        return out


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, text: str = "text", id: str = "doc_id", ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece.

    A document is the ids that the `tokenizers` library gives its text by the vocabulary's
    file, with no tokens added around it, then `end`; a special token's string in the text is
    that token, as in the library. Null or empty text is `end` alone. A sequence is padded
    to `window` by its reader, unless its length is a power of two. Null ids and rows that
    repeat an id are documents like others; other columns are ignored, whatever their names;
    no rows make no rows. Sequence ids are unique, and the same if a task runs again. With
    `ids`, a piece's ids are returned as bytes (little-endian uint32).
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    last = np.uint32(end).tobytes()

    def rows_of(packer: Packer) -> Iterator[pa.RecordBatch]:
        rows = packer.rows()
        if rows:
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array(columns[7], pa.binary())] if ids else [])
            yield pa.record_batch(arrays, names=names + ["ids"] * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(vocabulary)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                for doc, found in zip(part.column(0).to_pylist(), words.encode(part.column(1))):
                    packer.add(doc, found.tobytes() + last)
                yield from rows_of(packer)
        packer.finish()
        yield from rows_of(packer)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids binary" * ids)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """pack() of all documents with the default vocabulary: nulls, empty texts, repeated rows and other columns as there."""
    return pack(docs, default_vocabulary())
