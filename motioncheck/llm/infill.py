"""Fill-in-middle transformation of whole texts.

Method: big-integer bit-parallelism. A text's UTF-8 bytes are translated to a class mask, one
binary digit a byte, and read as one integer whose highest bit is the first byte. Shifted boolean
operations on all of it mark the bytes that end a token; bit_count gives the number of tokens.
A cut after so many tokens is the place of a ranked bit, found by recursive halving: the count of
the upper half says which half holds it, so all steps together touch twice the mask's length.
Code points are counted as bits of a second mask, of the bytes that begin one. Nothing is decoded,
no regular expression is run and no list of tokens is made: a text of n bytes takes n / 8 bytes a mask.

A token is a run of other characters with the white space before it; white space at the text's
end is a token of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncheck.llm import shared

SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Class masks: white space of ASCII (tab to carriage return, and space), and bytes that begin a code point.
_SPACE = bytes(0x31 if b == 0x20 or 0x09 <= b <= 0x0D else 0x30 for b in range(256))
_LEAD = bytes(0x30 if 0x80 <= b < 0xC0 else 0x31 for b in range(256))


def mask(data: bytes, table: bytes) -> int:
    """A bit for each byte, the first byte's the highest."""
    return int(data.translate(table), 2) if data else 0


def token_ends(data: bytes) -> int:
    """Bits of the bytes that end a token."""
    space = mask(data, _SPACE)
    word = space ^ ((1 << len(data)) - 1)
    # a word's byte ends a token if what follows isn't a word's; the text's last byte always does
    return (word & ~(word << 1)) | (1 if data else 0)


def ranked(bits: int, width: int, rank: int) -> int:
    """How far the rank-th set bit (1, 2, ... from the highest) of a number of so many bits is from the top, that bit included; 0 for rank 0."""
    if not rank:
        return 0
    before = 0
    while width > 1:
        low = width // 2
        upper = bits >> low
        held = upper.bit_count()
        if rank <= held:
            bits, width = upper, width - low
        else:
            bits, width, rank, before = bits & ((1 << low) - 1), low, rank - held, before + width - low
    return before + 1


def draws(seed: int, id: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(data: bytes, id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of a text's bytes."""
    ends = token_ends(data)
    n = ends.bit_count()
    p, s, m = (x.encode() for x in marks)
    if not data or id is None or p in data or s in data or m in data:
        return n, "plain", None, None, data
    h1, h2, h3, h4 = draws(seed, id)
    if h3 % 100 >= rate:
        return n, "plain", None, None, data
    first, second = (ranked(ends, len(data), k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    lead = mask(data, _LEAD)
    upto = (lead >> (len(data) - first)).bit_count()
    middle_chars = (lead >> (len(data) - second)).bit_count() - upto
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    if h4 % 100 < spm_rate:
        return n, "spm", upto, middle_chars, b"".join([s, suffix, p, prefix, m, middle])
    return n, "psm", upto, middle_chars, b"".join([p, prefix, s, suffix, m, middle])


def restore(output: bytes, form: str, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> bytes:
    """The text that transform() made an output of."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in marks)
    one, two = (s, p) if form == "spm" else (p, s)
    head, middle = output.split(m, 1)
    left, right = head.removeprefix(one).split(two, 1)
    return right + middle + left if form == "spm" else left + middle + right


def fill_in_middle(
    docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), digests: bool = False
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row, with digests=True output_sha256 and restored_sha256 in place of output.

    rate and spm_rate are percentages: of texts that are cut, and of these, that begin with the suffix. No mark may
    hold another mark or be one's beginning and end at once, so that outputs can be restored; ValueError otherwise.
    A null text is an empty one; empty texts, texts with a mark in them and rows with a null id stay plain (an id is
    all that draws depend on, so repeated rows have equal results). Other columns are not looked at.
    """
    if any(not x or (x in y and i != j) or any(x[:k] == y[-k:] for k in range(1, len(x)) for y in marks) for i, x in enumerate(marks) for j, y in enumerate(marks)):
        raise ValueError("marks must not be empty, nor hold or overlap one another")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = []
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            n, form, before, middle, output = transform(data.as_py() or b"", key, seed, rate, spm_rate, marks)
            made.append((key, n, form, before, middle, *((hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form, marks)).hexdigest()) if digests else (output,))))
        kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), *([pa.string()] * 2 if digests else [pa.binary()])]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    names = ["id", "n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digests else ["output"])]
    schema = f"id {docs.schema[id].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, " + ("output_sha256 string, restored_sha256 string" if digests else "output binary")
    found = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(lambda batches: shared.each((b for b in batches if b.num_rows), rows), schema)
    return found.select(F.col("id").alias(id), *(F.col(x).cast("string") if x == "output" else F.col(x) for x in names[1:]))


def restored(made: DataFrame, output: str = "output", form: str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Adds restored, the text that each output was made of, to what fill_in_middle() returned, by built-in functions alone. A null output or form gives null."""
    p, s, m = marks
    out = F.col(output)

    def cut(one: str, two: str):
        second, third = F.instr(out, two), F.instr(out, m)
        left = F.substring(out, F.lit(len(one) + 1), second - len(one) - 1)
        right = F.substring(out, second + len(two), third - second - len(two))
        return left, right, F.substring(out, third + len(m), F.length(out))

    left, right, middle = cut(s, p)
    spm = F.concat(right, middle, left)
    left, right, middle = cut(p, s)
    return made.withColumn("restored", F.when(F.col(form) == "plain", out).when(F.col(form) == "spm", spm).when(F.col(form) == "psm", F.concat(left, middle, right)))
