"""Personal data in whole texts: emails, IPv4 addresses, payment cards and phone numbers, plain and disguised.

Method: offset-preserving deobfuscation. Plain identifiers (the base) are found in the text as it
is. Then three transducers rewrite it, one after another, and each keeps where every rewritten
piece came from: characters (homoglyphs, digits of other scripts and full width to ASCII; characters
without width go), spelled digits (in four languages, `double` and `triple` too, joined with the
digits beside them), and at/dot disguises (bracketed, spelled, or as character references). The same
detectors run on the rewritten text, and what they find is mapped back, so a span always names
characters of the source. A text without any cue of a transducer passes it unchanged, at the cost of
one search.

All steps take time in line with a text's length: matches are anchored at what an identifier can't
do without, and nothing is tried again from every character of a long run.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncheck.llm import shared

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: What an email needs from its at sign on; what stands before it is taken backwards.
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match can only begin at a run's first digit: what fails there fails from all digits of the run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
#: Chains of fewer than 12 digits are no cards; a longer one is matched whole from its first digit.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            start = done + len(text[done:at].rstrip(_LOCAL))
            if start < at:
                yield start, host.end()
                done = host.end()
        if not host or done <= at:
            done = max(done, at + 1)  # no local part reaches over an at sign
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


_FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the plain patterns, by kind, in code points."""
    return {kind: list(find(text)) for kind, find in _FINDERS.items()}


class Rewritten:
    """A text with some pieces replaced, and where every character came from.

    edits: (start, end, replacement) in the source, ascending and apart. A span of the result is mapped
    to the source span of all it holds: a replaced piece counts whole, wherever the span begins or ends in it.
    """

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.of = [], [], []  # edits in the result and in the source
        done = size = 0
        for start, end, new in edits:
            parts += [source[done:start], new]
            size += start - done
            self.at.append((size, size + len(new)))
            self.of.append((start, end))
            size += len(new)
            done = end
        self.text = "".join([*parts, source[done:]]) if edits else source
        self._starts = [a for a, _ in self.at]

    def _char(self, i: int) -> Span:
        """The source span of one character."""
        k = bisect_right(self._starts, i) - 1
        if k < 0:
            return i, i + 1
        (_, end), (start_of, end_of) = self.at[k], self.of[k]
        return (start_of, end_of) if i < end else (end_of + i - end, end_of + i - end + 1)

    def back(self, span: Span) -> Span:
        return self._char(span[0])[0], self._char(span[1] - 1)[1]


# Letters of the Greek and Cyrillic scripts and the ASCII letters that they look like.
_LOOKS = {
    "ΑАＡ": "A", "ΒВ": "B", "СϹ": "C", "ΕЕ": "E", "ΗН": "H", "ΙІӀ": "I", "Ј": "J", "ΚК": "K", "ΜМ": "M", "ΝԊ": "N", "ΟО": "O", "ΡР": "P", "Ѕ": "S", "ΤТ": "T", "ΧХ": "X", "ΥҮ": "Y", "Ζ": "Z",
    "аα": "a", "сϲ": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "іıι": "i", "јϳ": "j", "ӏ": "l", "оοσ": "o", "рρ": "p", "ԛ": "q", "ѕ": "s", "υ": "u", "ѵν": "v", "ԝ": "w", "хχ": "x", "уγ": "y",
}
# Other marks.
_MARKS = {"\u2010\u2011\u2012\u2013\u2014\u2212\ufe63": "-", "\u2024\u3002\uff61\ufe52": ".", "\ufe6b": "@", "＋\ufe62": "+", "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000": " "}
_NO_WIDTH = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"

#: By rule: full width to ASCII, and every decimal digit to its value; then the lists above.
_FOLD = {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_FOLD |= {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None}
_FOLD |= {ord(c): to for looks in (_LOOKS, _MARKS) for many, to in looks.items() for c in many}


def _charset(points: list[int]) -> str:
    """The points as ranges of a regular expression's class."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


_ODD = re.compile(f"[{_charset([*_FOLD, *map(ord, _NO_WIDTH)])}]+")
_DROP = dict.fromkeys(map(ord, _NO_WIDTH))


def characters(text: str) -> list[tuple[int, int, str]]:
    """Edits of homoglyphs, other scripts' digits and characters without width."""
    if text.isascii():
        return []
    return [(i, i + 1, _FOLD.get(ord(c), "")) for m in _ODD.finditer(text) for i, c in enumerate(m.group(), m.start())]


# The digits' names in English, German, French and Spanish.
_DIGITS = {
    "0": "zero oh null zéro cero", "1": "one eins un une uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf fuenf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_TIMES = {"double": 2, "triple": 3}
_PLUS = "plus"
_VALUE = {word: digit for digit, words in _DIGITS.items() for word in words.split()}
_NAME = f"(?:(?:{'|'.join(_TIMES)})[ -])?(?:{'|'.join(sorted(_VALUE, key=len, reverse=True))})(?![^\\W_])"
_GAP = r"(?:[ \t\r\n]{1,2}|, ?|-)"
#: Two units or more, the first or second spelled; digits in it may stand in groups.
_SPELLED = re.compile(rf"(?<![^\W_])(?:({_PLUS}){_GAP}?)?((?:{_NAME}|[0-9]+{_GAP}{_NAME})(?:{_GAP}(?:{_NAME}|[0-9]+(?![^\W_])))*)", re.I)
_UNIT = re.compile(rf"({_NAME})|([0-9]+)", re.I)


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Edits of runs of digits with spelled ones among them: names become digits, and what stands between goes.

    A single name beside no other digit stays a word.
    """
    out: list[tuple[int, int, str]] = []
    for run in _SPELLED.finditer(text):
        units = list(_UNIT.finditer(text, *run.span(2)))
        if len(units) < 2 and not (len(units) == 1 and _dotted(text, *run.span(2))):
            continue
        if run.group(1):
            out.append((run.start(1), run.start(2), "+"))
        for i, unit in enumerate(units):
            if i:
                out.append((units[i - 1].end(), unit.start(), ""))
            if unit.group(1):
                times, _, name = unit.group(1).casefold().replace("-", " ").rpartition(" ")
                out.append((unit.start(), unit.end(), _VALUE[name] * _TIMES.get(times, 1)))
    return out


# How the two signs are written out in the four languages; as character references; in brackets.
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase|klammeraffe", "dot|punkt|point|punto"
_AT_CODES, _DOT_CODES = r"&\#0*64;|&\#x0*40;|&commat;", r"&\#0*46;|&\#x0*2e;|&period;"
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_SURE_AT = rf"[ \t]*+(?:{_OPEN} ?(?:{_AT_WORDS}|@) ?{_CLOSE}|{_AT_CODES})[ \t]*+"
_BARE_AT = rf"[ \t\r\n]++(?:{_AT_WORDS}|@)[ \t\r\n]++"
_VEILED_DOT = rf"(?:[ \t]*+(?:{_OPEN} ?(?:{_DOT_WORDS}|\.) ?{_CLOSE}|{_DOT_CODES})[ \t]*+|[ \t\r\n]++(?:{_DOT_WORDS}|\.)[ \t\r\n]++)"
_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:(?P<sure>{_SURE_AT})|(?P<bare>{_BARE_AT})|@)(?=[A-Za-z0-9])", re.I)
_DOT = re.compile(rf"(?<=[A-Za-z0-9_%+-]){_VEILED_DOT}(?=[A-Za-z0-9_%+-])", re.I)
_LABELS = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_VEILED_DOT})[A-Za-z0-9-]++)++", re.I)
_TOP = re.compile(r"[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]\Z")
#: Is there any cue? Words of a sign, a bracketed sign, a sign between spaces, or a reference.
_CUE = re.compile(rf"\b(?:{_AT_WORDS}|{_DOT_WORDS})\b|[(\[{{<] ?[@.] ?[)\]}}>]|\s[@.]\s|&(?:\#|commat;|period;)", re.I)


def _dotted(text: str, start: int, end: int) -> bool:
    """Does a veiled or plain dot stand beside text[start:end], with a digit or its name behind it?"""
    return bool(_BEFORE.search(text, max(0, start - 24), start) or _BEHIND.match(text, end))


_BEFORE = re.compile(rf"(?:[0-9]|(?<![^\W_]){_NAME}){_VEILED_DOT}\Z", re.I)
_BEHIND = re.compile(rf"{_VEILED_DOT}(?:[0-9]|{_NAME})", re.I)


def signs(text: str) -> list[tuple[int, int, str]]:
    """Edits of disguised at signs and dots.

    A dot between digits is one. An at sign is one before a host name with a dot; if it is a bare word
    (or stands alone between spaces), only where a dot of the host is disguised as well, as `at` and
    `dot` are words of their own. Dots before it are taken with it.
    """
    if not _CUE.search(text):
        return []
    dots = [m.span() for m in _DOT.finditer(text)]
    if not dots and "(" not in text and "[" not in text and "{" not in text and "<" not in text and "&" not in text:
        return []
    edits = {d: "." for d in dots if text[d[0] - 1].isdigit() and text[d[1]].isdigit()}
    ends = {end: start for start, end in dots}
    for m in _AT.finditer(text):
        host = _LABELS.match(text, m.end())
        if not host or not _TOP.search(re.split(rf"\.|{_VEILED_DOT}", host.group(), flags=re.I)[-1]):
            continue
        veiled = [d for d in dots[bisect_right(dots, (m.end(), 0)) : bisect_right(dots, (host.end(), 0))] if d[1] < host.end()]
        plain_at = m.group() == "@"
        if (m.group("bare") or plain_at) and not veiled or plain_at and "." in text[m.end() : veiled[0][0]]:
            continue
        if not plain_at:
            edits[m.span()] = "@"
        edits |= dict.fromkeys(veiled, ".")
        start = m.start()
        while not plain_at:  # names before it that are joined by disguised dots
            start = _local_start(text, start)
            if start not in ends:
                break
            edits[(ends[start], start)] = "."
            start = ends[start]
    return sorted((a, b, new) for (a, b), new in edits.items())


def _local_start(text: str, end: int) -> int:
    while end and text[end - 1] in _LOCAL:
        end -= 1
    return end


def spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base, added) spans by kind: added ones are disguised.

    Of the spans found in the rewritten text those stay that meet no base span of their kind, or
    that hold all those that they meet and more (an email of which only a part is plain).
    """
    base = base_spans(text)
    steps: list[Rewritten] = []
    now = text
    for rewrite in (characters, spelled_digits, signs):
        edits = rewrite(now)
        if edits:
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    for kind in KINDS if steps else ():
        own = base[kind]
        for span in _FINDERS[kind](now):
            for step in reversed(steps):
                span = step.back(span)
            start, end = span
            first = bisect_right(own, (start, start))
            first -= bool(first and own[first - 1][1] > start)
            met = [s for s in own[first : bisect_right(own, (end, 0))] if s[0] < end]
            if all(start <= a and b <= end and (a, b) != span for a, b in met):
                added[kind].append(span)
    return base, added


def joined(found: dict[str, list[Span]]) -> str:
    """kind:start:end, by start and then by kind, comma-joined."""
    order = sorted((start, KINDS.index(kind), end) for kind, own in found.items() for start, end in own)
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in order)


def find_personal(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row.

    The four numbers and the digest are of the base; spans has the base and the disguised ones, n_added
    is the number of these. A null or empty text has none of them and empty spans. Repeated rows and rows with
    null ids have rows of their own. Other columns are not looked at.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            base, added = spans(value.as_py() or "")
            every = {kind: base[kind] + added[kind] for kind in KINDS}
            made.append((key, *(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, added.values()))))
        kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = f"id {docs.schema[id].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    found = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(lambda batches: shared.each((b for b in batches if b.num_rows), rows), schema)
    return found.withColumnRenamed("id", id) if id != "id" else found


def mask(text: str, names: dict[str, str]) -> str:
    """The text with each span replaced by its kind's name; of spans that meet, all are one piece with the first one's name."""
    base, added = spans(text)
    out, done = [], 0
    pieces: list[list] = []
    for start, kind, end in sorted((a, KINDS.index(k), b) for found in (base, added) for k, own in found.items() for a, b in own):
        if pieces and start < pieces[-1][2]:
            pieces[-1][2] = max(pieces[-1][2], end)
        else:
            pieces.append([start, KINDS[kind], end])
    for start, kind, end in pieces:
        out += [text[done:start], names[kind]]
        done = end
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """docs with personal data, plain and disguised, replaced by names (`<EMAIL>` and so on) in the text; all columns and rows stay. A null text stays null."""
    names = {k: f"<{k.upper()}>" for k in KINDS} | (names or {})
    at = docs.columns.index(text)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = pa.array([None if (x := v.as_py()) is None else mask(x, names) for v in batch.column(at)], batch.schema.field(at).type)
        yield batch.set_column(at, batch.schema.field(at), made)

    return docs.mapInArrow(lambda batches: shared.each(batches, rows), docs.schema)
