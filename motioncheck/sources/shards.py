"""Shards of many framed records: read in ranges by several tasks, and written by tasks with one commit.

A shard has no marks to start from in its middle, so a first pass skips from length to length (eight
bytes of every record are read) and cuts it into ranges of whole records. Ranges are dealt to
tasks, each of which reads only its own. Files are opened by pyarrow's file systems, in the workers;
for stores that only Spark can open, framed.read_records() reads whole files by Spark's binary source.

The sink is a Spark data source: each task writes a file of its own in a pending folder, and the
commit moves the files of the attempts that Spark chose. A failed job leaves nothing behind, and a
killed attempt's file goes with the pending folder.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from motioncheck import schema
from motioncheck.sources import framed
from motioncheck.sources.stored import stored

#: Bytes of a range, about, and of a batch of records.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
RECORDS = "path string, record_ord long, payload binary"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it; `file:` and bare paths are local."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def listed(paths: str | list[str]) -> list[str]:
    """The files that are named, and those of named folders but for hidden ones."""
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        store, own = located(path)
        if store.get_file_info(own).type != fs.FileType.Directory:
            out.append(path)
            continue
        names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(own)) if i.type == fs.FileType.File and i.base_name[0] not in "._")
        out += [f"{path.rstrip('/')}/{n}" for n in names]
    return out


def ranges(path: str, range_bytes: int) -> Iterator[tuple[str, int, int, int]]:
    """(path, first byte, end, first record) of a shard's ranges of whole records, by their lengths alone."""
    store, own = located(path)
    with store.open_input_file(own) as file:
        size = file.size()
        start = first = at = record = 0
        while at < size:
            for what, n in (("length", 8), ("length checksum", 12)):
                if at + n > size:
                    raise framed.RecordFormatError(f"record {record}: truncated {what}")
            (n,) = struct.unpack("<Q", file.read_at(8, at))
            for what, end in (("payload", at + 12 + n), ("payload checksum", at + 16 + n)):
                if end > size:
                    raise framed.RecordFormatError(f"record {record}: truncated {what}")
            at, record = at + 16 + n, record + 1
            if at - start >= range_bytes or at == size:
                yield path, start, at, first
                start, first = at, record


def read_shards(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, record_ord, payload) of framed shards. A record cut short is an error that names it, before any record is read."""
    names = spark.createDataFrame([(p,) for p in listed(paths)], "path string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if found := list(ranges(path, range_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["path", "start", "end", "first"])

    index = stored(names.repartition(max(1, names.count()), "path").mapInArrow(cut, "path string, start long, end long, first long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                store, own = located(one["path"])
                with store.open_input_file(own) as file:
                    held, size, at, record = [], 0, one["start"], one["first"]
                    while at < one["end"]:
                        (n,) = struct.unpack("<Q", file.read_at(8, at))
                        held.append((one["path"], record, file.read_at(n, at + 12)))
                        at, record, size = at + 16 + n, record + 1, size + n
                        if size >= BATCH_BYTES or at >= one["end"]:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), (pa.string(), pa.int64(), pa.binary()))], ["path", "record_ord", "payload"])
                            held, size = [], 0

    dealt = index.repartitionByRange(max(1, index.count()), "path", "start")
    return dealt.mapInArrow(read, RECORDS)


def decoded(records: DataFrame, decode: Callable[[bytes], dict] | None = None, min_valid_states: int = 1) -> DataFrame:
    """Nested scenarios of records (path, record_ord, payload). `decode` makes a scenario's fields of a payload, in place of the wire format's own decoder."""
    if min_valid_states < 1:
        raise ValueError("min_valid_states must be positive")
    make = decode or (lambda payload: framed.decode_scenario(payload, min_valid_states))
    kind, arrow = framed._arrow(f"{schema.SCENARIO}, {schema.MAP}, path string, record_ord long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                path, record, payload = (c[row].as_py() for c in batch.columns)
                yield pa.RecordBatch.from_pylist([make(payload) | {"path": path, "record_ord": record}], schema=arrow)

    return records.select("path", "record_ord", "payload").mapInArrow(run, kind)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, framing: bool = True, tail: bytes = b""):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.framing, self.tail = framing, tail

    def _pending(self) -> tuple[fs.FileSystem, str, str]:
        store, own = located(self.path)
        return store, own, f"{own}/_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, _, pending = self._pending()
        store.create_dir(pending, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.framed", 0
        with store.open_output_stream(f"{pending}/{name}") as out:
            for batch in iterator:
                for payload in batch.column(batch.schema.get_field_index("payload")):
                    own = payload.as_py() or b""
                    out.write(framed.frame(own) if self.framing else own)
                    n += 1
            out.write(self.tail)
        return Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, own, pending = self._pending()
        store.create_dir(own, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(own)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for m in messages:
            if m is not None and m.records:
                store.move(f"{pending}/{m.name}", f"{own}/{m.name}")
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, pending = self._pending()
        if store.get_file_info(pending).type == fs.FileType.Directory:
            store.delete_dir(pending)


class FramedSink(DataSource):
    """`framed`: a column payload goes to framed shards under a path, one for each task that has rows.

    Options: framing=none writes payloads as they are; tail, in hexadecimal, ends each file.
    """

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return "payload binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite, self.options.get("framing") != "none", bytes.fromhex(self.options.get("tail", "")))


def write_shards(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes the column payload as framed shards, a file per partition that has rows; null payloads are empty records."""
    records.sparkSession.dataSource.register(FramedSink)
    records.select(F.col("payload")).write.format("framed").mode(mode).save(path)


def write_fragments(records: DataFrame, path: str, tail: bytes = b"") -> None:
    """Writes the column payload as it is, a file per partition that has rows, each with the tail at its end; names are in the order of partitions."""
    records.sparkSession.dataSource.register(FramedSink)
    records.select("payload").write.format("framed").mode("overwrite").option("framing", "none").option("tail", tail.hex()).save(path)


def join_fragments(folder: str, path: str, head: bytes = b"", tail: bytes = b"", skip: int = 0) -> None:
    """One file of a folder's files, one after another in the order of their names, without their first `skip` bytes in all.

    Streamed in pieces of BATCH_BYTES into a pending file beside the target, which it replaces when it is whole.
    """
    store, own = located(path)
    pending = f"{own}.pending-{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(pending) as out:
            out.write(head)
            for name in listed(folder):
                source, part = located(name)
                with source.open_input_stream(part) as file:
                    while piece := file.read(BATCH_BYTES):
                        out.write(piece[skip:])
                        skip = max(0, skip - len(piece))
            out.write(tail)
        store.move(pending, own)
    except BaseException:
        if store.get_file_info(pending).type == fs.FileType.File:
            store.delete_file(pending)
        raise
