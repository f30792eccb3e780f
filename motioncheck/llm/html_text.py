"""Main text of web pages.

Method: a host suffix array, then a check by the page's own structure. A pass over the markup
gives each page its blocks of text. All of them are in the token streams of their host, articles'
blocks in one and the others in another; the streams of its pages are concatenated, a suffix array
finds the long substrings that distinct pages share, and a block that they cover is boilerplate.

The suffix array alone can't give right results: menus, adverts and footers may be unique text,
which repetition doesn't find, while articles quote one another. So where the page's structure is
sure, it corrects the array: a block of the article (or main part) that other articles have too is
restored, and counted; menus, footers, adverts, forms, comments and the like go, unique or not.
Where it isn't sure, the array's word stands: for the blocks of pages without an article, and
those in an article whose class only hints at no text (such as "section-header").

A host may have any number of pages, so its suffix array is in shards: a stretch of tokens whose
windows have one minimizer goes to that minimizer's shard, where equal windows are side by side.
Equal stretches are one before the shuffle, so a line on all pages of a host isn't hot; in articles
each page's place is sent beside them. In articles a bitmap of the minimizers that two pages have comes first: a stretch whose
minimizer no other page has can't be shared, and most are of that kind.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncheck.llm import shared, words
from motioncheck.llm.suffixes import digests, distinct_kinds, pack_stretches, repeated_starts, repeated_tokens, unpack_stretches
from motioncheck.llm.urls import host_and_path

#: Tokens that a substring has at least to be boilerplate, and of the hashes whose least is a window's minimizer.
LEAST, GRAM = 5, 2
#: The same in articles, which have shorter phrases in common by chance.
LONG, LONG_GRAM = 13, 4
#: Bits of the bitmap of pages that share words in articles: 2 MB.
PAGE_BITS = 24

#: What a block is: text by structure; to be decided, in an article or where there is none; no text.
TEXT, DOUBTFUL, OPEN, ASIDE = range(4)

#: Elements of HTML by their use.
RAW = frozenset("script style template noscript textarea title iframe svg object select".split())
NO_TEXT = frozenset("nav footer aside form menu dialog button fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of text; of formulas too.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics".split())
#: Words of class, id and role that mark what is no text.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot sidebar side aside notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login form share sharing social widget related recommended comment comments commentlist disqus respond replies reviews complementary contentinfo search".split())
#: Those that also mark it in an article when other words follow, or on an article itself.
LOUD = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe related recommended comment comments commentlist disqus respond replies reviews".split())
#: Words that make a mark a property of what holds it.
HAVING = frozenset("has have with no without hide".split())

_markup = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_stop = re.compile(r"=\s*([\"'])|>")
_attribute = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_main = re.compile(r"(?:^|\s)role\s*=\s*[\"']?\s*(?:main|article)\b", re.I)
_word = re.compile(r"[a-z]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_closing = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


@lru_cache(1 << 16)
def role(tag: str, attributes: str, in_article: bool) -> int:
    """What an element makes of its text: TEXT (nothing), DOUBTFUL or ASIDE."""
    if tag in NO_TEXT or tag == "header" and not in_article:
        return ASIDE
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return TEXT
    if _hidden.search(attributes):
        return ASIDE
    found = TEXT
    for _, value in _attribute.findall(attributes):
        for name in value.strip("\"'").split():
            parts = _word.findall(_camel.sub(" ", name).lower())
            if tag in ("body", "html") or not parts or parts[0] in HAVING or MARKS.isdisjoint(parts):
                continue
            if tag in ("article", "main") or _main.search(attributes):
                if parts[0] in LOUD:
                    return ASIDE
            elif not in_article or parts[0] in LOUD or MARKS.issuperset(parts) and parts != ["header"]:
                return ASIDE
            else:
                found = DOUBTFUL
    return found


def blocks(page: str) -> list[tuple[int, str]]:
    """What each block of a page is, and its text, in page order; white space within a block is one space.

    One pass: nothing is looked at again, whatever is left open or unbalanced.
    """
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, its role, whether it is an article
    places: dict[str, list[int]] = {}  # of a tag's open elements in the stack
    held = [0, 0, 0, 0]  # open elements by role
    depth = at = 0
    text: list[str] = []
    unclosed: set[str] = set()  # quotes that don't come again

    def flush() -> None:
        if text:
            own = " ".join(entities.unescape("".join(text)).split())
            if own:
                found.append((ASIDE if held[ASIDE] else OPEN if not depth else DOUBTFUL if held[DOUBTFUL] else TEXT, own))
            text.clear()

    def close(index: int) -> None:
        nonlocal depth
        while len(stack) > index:
            tag, own, main = stack.pop()
            places[tag].pop()
            held[own] -= 1
            depth -= main

    end = len(page)
    while at < end:
        m = _markup.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        start = m.group()
        closer = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}.get(start)
        if closer:
            stop = page.find(closer, m.end())
            at = stop + len(closer) if stop >= 0 else end
            continue
        m = _tag.match(page, m.start())
        first = at = m.end()
        while True:  # to the end of the tag, over quoted values
            stop = _stop.search(page, at)
            if stop is None:
                at = end
                break
            at, quote = stop.end(), stop.group(1)
            if not quote:
                break
            if quote not in unclosed:
                to = page.find(quote, at)
                if to < 0:
                    unclosed.add(quote)
                else:
                    at = to + 1
        attributes = page[first : at - (stop is not None)]
        tag = m.group(2).lower()
        if tag not in INLINE:
            flush()
        if m.group(1):
            if places.get(tag) and tag not in VOID:
                close(places[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            stop = _closing[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in ("p", "li") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        own = role(tag, attributes, depth > 0)
        if own:
            flush()
        main = tag in ("article", "main") or bool(_main.search(attributes))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, own, main))
        held[own] += 1
        depth += main
    flush()
    return found


def _owner(page: list[tuple[int, str]]) -> int:
    """A hash of all blocks of a page: that of its copies too."""
    return int.from_bytes(hashlib.blake2b("\n".join(f"{kind} {text}" for kind, text in page).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _plan(page: list[tuple[int, str]]) -> tuple[list[str], list[int], list[str], list[str]]:
    """Of a page's blocks: those that are or may be its text, where each of these is in its stream (-1: in the article's), the stream, the article's.

    The stream has the blocks to be decided, then the others outside the article; between them
    stands a token that only the page's copies have, so that no substring goes across. The
    article's has its blocks in page order.
    """
    has = any(kind in (TEXT, DOUBTFUL) for kind, _ in page)
    ask = DOUBTFUL if has else OPEN
    own, place, stream = [], [], []
    for kind, text in page:
        if kind in (TEXT, ask):
            own.append(text)
            place.append(-1 if kind == TEXT else len(stream))
            if kind == ask:
                stream.append(text)
    rest = [text for kind, text in page if kind not in (TEXT, ask)]
    if stream and rest:
        stream.append(f"\0{_owner(page)}")
    return own, place, stream + rest, [text for kind, text in page if kind == TEXT]


def _kept(own: list[str], place: list[int], stream: list[str], covered: np.ndarray) -> tuple[str, int]:
    """The page's text: its blocks less those that are covered whole, but for the article's; and the covered words of the others that stay."""
    cuts = np.cumsum([0, *(len(block.split()) for block in stream)])
    stay = [p < 0 or not covered[cuts[p] : cuts[p + 1]].all() for p in place]
    loose = sum(int(covered[cuts[p] : cuts[p + 1]].sum()) for p, s in zip(place, stay) if s and p >= 0)
    return " ".join(text for text, s in zip(own, stay) if s), loose


def _restored(sizes: list[int], covered: np.ndarray) -> tuple[int, int]:
    """The covered words of an article, and its blocks that are covered whole; sizes: words of each block."""
    return int(covered.sum()), sum(bool(block.all()) for block in np.split(covered, np.cumsum(sizes)[:-1]) if len(block))


def host_judged(pages: list[list[tuple[int, str]]]) -> list[tuple[str, int, int]]:
    """(text, n_shared, n_restored) of each page of one host, from blocks(): what main_texts() finds, on one machine."""
    plans = [_plan(page) for page in pages]
    owners = [_owner(page) for page in pages]
    covered = repeated_tokens([[t for block in stream for t in block.split()] for _, _, stream, _ in plans], LEAST, owners)
    quoted = repeated_tokens([[t for block in article for t in block.split()] for *_, article in plans], LONG, owners)
    found = []
    for (own, place, stream, article), outside, inside in zip(plans, covered, quoted):
        text, loose = _kept(own, place, stream, outside)
        n, restored = _restored([len(block.split()) for block in article], inside)
        found.append((text, loose + n, restored))
    return found


def host_texts(pages: list[list[tuple[int, str]]]) -> list[str]:
    """The text of each page of one host, from blocks()."""
    return [text for text, _, _ in host_judged(pages)]


def _streams(stream: pa.Array, host: pa.Array) -> Iterator[words.Chunk]:
    """Words of pages' streams, with hashes that are the host's own; 48 bits count."""
    return _hashed(pa.array([" ".join(own or ()) for own in stream.to_pylist()], pa.large_string()), host)


def _hashed(texts: pa.Array, host: pa.Array) -> Iterator[words.Chunk]:
    hosts = host.to_numpy().view(np.uint64)
    for chunk in words.chunks(texts):
        mixed = words.mix(chunk.hashes ^ words.mix(hosts[chunk.row : chunk.row + chunk.docs])[chunk.doc_of_word()])
        chunk.hashes = mixed >> np.uint64(16) << np.uint64(16)
        yield chunk


def _windows(hashes: np.ndarray) -> np.ndarray:
    return words.ngrams(hashes >> np.uint64(16), LEAST).view(np.int64)


def _repeated(parsed: DataFrame) -> DataFrame:
    """(window): hashes of the LEAST tokens in a row that two different pages of a host have."""
    bits = shared.bucket_bits(parsed.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for chunk in _streams(batch.column(1), batch.column(0)):
                starts, least = words.minimizers(chunk, LEAST, GRAM)
                at = words.runs(starts, least)
                if len(at):
                    lengths = np.diff(np.append(at, len(starts))) + LEAST - 1
                    owner = batch.column(2).to_numpy()[chunk.row + chunk.doc_of_word()[starts[at]]]
                    parts.append((least[at], lengths, owner, chunk.hashes[words.spread(starts[at], lengths)]))
            if parts:
                least, lengths, owner, text = (np.concatenate(p) for p in zip(*parts))
                firsts = np.cumsum(lengths) - lengths
                one, low, high = distinct_kinds(digests(text, firsts, lengths), owner, owner)
                yield pack_stretches(least[one], bits, text, firsts[one], lengths[one], low, high, np.zeros(len(one)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packed in shared.by_bucket(batches):
            low, high, _, lengths, text = unpack_stretches(packed)
            lengths = lengths.astype(np.int64)
            firsts = np.cumsum(lengths) - lengths
            one, low, high = distinct_kinds(digests(text, firsts, lengths), low, high)
            own = text[words.spread(firsts[one], lengths[one])]
            found = _windows(own << np.uint64(16))[repeated_starts(own, lengths[one], low, high, LEAST)]
            if len(found):
                yield pa.record_batch([pa.array(words.distinct(found))], names=["window"])

    blocks = parsed.select(F.xxhash64("host").alias("host"), "stream", "owner").mapInArrow(deal, shared.BLOCKS)
    return shared.dealt(blocks).mapInArrow(search, "window long").distinct()


def _runs(chunk: words.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of an article's windows that have one minimizer: the minimizer, evenly spread, the run's first word, its words."""
    starts, least = words.minimizers(chunk, LONG, LONG_GRAM)
    at = words.runs(starts, least)
    return words.mix(least[at]), starts[at], np.diff(np.append(at, len(starts))) + LONG - 1


def _marks(articles: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the minimizers that articles of two keys have; articles: (hash, key, text)."""

    def make(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        keys = batch.column(1).to_numpy()
        for chunk in _hashed(batch.column(2), batch.column(0)):
            least, starts, _ = _runs(chunk)
            yield least, keys[chunk.row + chunk.doc_of_word()[starts]]

    def reduce(least: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch | None]:
        one, low, high = distinct_kinds(least, keys, keys)
        yield shared.slim(np.concatenate([least[one], least[one][low != high]]), bits)

    return shared.shared_bitmap(articles.mapInArrow(lambda batches: shared.gathered(batches, make, reduce), shared.BLOCKS), bits, owned=False)


def _quoted(articles: DataFrame) -> DataFrame:
    """(key, at, n): in an article, n windows of LONG tokens from token `at` on that articles of other keys have.

    articles: (hash, key, text); the key is that of a host and its page's copies.
    """
    bits = shared.bucket_bits(articles.sparkSession)
    marks = articles.sparkSession.sparkContext.broadcast(_marks(articles, bits))

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column(1).to_numpy()
        first = np.zeros(len(keys), bool)
        first[np.unique(keys, return_index=True)[1]] = True  # of copies
        parts = []
        for chunk in _hashed(batch.column(2), batch.column(0)):
            least, starts, lengths = _runs(chunk)
            doc = chunk.doc_of_word()[starts]
            may = np.flatnonzero(shared.marked(marks.value, least) & first[chunk.row + doc])
            if len(may):
                parts.append((least[may], lengths[may], keys[chunk.row + doc[may]], starts[may] - chunk.first[doc[may]], chunk.hashes[words.spread(starts[may], lengths[may])]))
        if parts:
            least, lengths, owner, places, text = (np.concatenate(p) for p in zip(*parts))
            firsts = np.cumsum(lengths) - lengths
            kinds = digests(text >> np.uint64(16), firsts, lengths)
            again = np.ones(len(kinds), bool)  # a stretch that came before is sent as its digest
            again[np.unique(kinds, return_index=True)[1]] = False
            yield pack_stretches(least, bits, text, firsts, np.where(again, 0, lengths), owner, np.where(again, kinds.view(np.int64), 0), places)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packed in shared.by_bucket(batches):
            keys, sent, places, lengths, text = unpack_stretches(packed)
            lengths = lengths.astype(np.int64)
            firsts = np.cumsum(lengths) - lengths
            whole = lengths > 0
            kinds = sent.astype(np.uint64)
            kinds[whole] = digests(text, firsts[whole], lengths[whole])
            one, low, high = distinct_kinds(kinds, keys, keys)
            of = np.searchsorted(kinds[one], kinds)
            begins = np.cumsum(lengths[one]) - lengths[one]
            found = repeated_starts(text[words.spread(firsts[one], lengths[one])], lengths[one], low, high, LONG)
            if not len(found):
                continue
            stretch = np.searchsorted(begins, found, "right") - 1
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(found) > 1) | (np.diff(stretch) > 0)]))
            n, stretch = np.diff(np.append(cuts, len(found))), stretch[cuts]
            at = found[cuts] - begins[stretch]  # in the stretch
            has = np.bincount(stretch, minlength=len(one))
            each = np.repeat(np.arange(len(keys)), has[of])
            run = words.spread((np.cumsum(has) - has)[of], has[of])
            yield pa.record_batch([pa.array(keys[each]), pa.array((places[each] + at[run]).astype(np.int32)), pa.array(n[run].astype(np.int32))], names=["key", "at", "n"])

    return shared.dealt(articles.mapInArrow(lambda batches: shared.each(batches, deal), shared.BLOCKS)).mapInArrow(search, "key long, at int, n int").distinct()


PARSED = "page_id long, url string, host string, text string, sizes array<int>, own array<string>, place array<int>, stream array<string>, owner long"
COUNTS = "n_shared long, n_restored long"


def main_texts(pages: DataFrame, html: str = "html", url: str = "url", id: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars, host, n_shared, n_restored) per row of pages.

    n_shared is how many words of the text stand in substrings that the host's array finds on other
    pages, of 13 tokens in articles and 5 outside; n_restored is how many blocks of it the array
    alone takes for boilerplate, as such substrings cover them, and structure restores.

    Null or empty html has the empty text; a page that is no markup is one block. Pages are
    parsed once, and their blocks written. Pages of a host with the same blocks count as one, so
    copies and repeated rows keep their text. Null urls belong to the empty host. Null ids and
    rows that repeat an id are rows of their own; other columns are ignored, whatever their
    names; no rows make no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page.as_py() or "") for page in batch.column(3)]
            plans = [_plan(page) for page in found]
            sure = [max(place, default=-1) < 0 for _, place, _, _ in plans]
            yield pa.record_batch([
                *batch.columns[:3],
                pa.array([" ".join(article) for *_, article in plans], pa.string()),
                pa.array([[block.count(" ") + 1 for block in article] for *_, article in plans], pa.list_(pa.int32())),
                pa.array([None if s else own for (own, *_), s in zip(plans, sure)], pa.list_(pa.string())),
                pa.array([None if s else place for (_, place, *_), s in zip(plans, sure)], pa.list_(pa.int32())),
                pa.array([stream for _, _, stream, _ in plans], pa.list_(pa.string())),
                pa.array([_owner(page) for page in found], pa.int64()),
            ], names=["page_id", "url", "host", "text", "sizes", "own", "place", "stream", "owner"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _streams(batch.column(2), batch.column(1)):
                windows = _windows(chunk.hashes)
                found = [np.unique(windows[a : max(a, b - LEAST + 1)]) for a, b in zip(chunk.first[:-1], chunk.first[1:])]
                yield pa.record_batch([batch.column(0).slice(chunk.row, chunk.docs), pa.array(found, pa.list_(pa.int64()))], names=["key", "windows"])

    def twice(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch | None]:
        keys = batch.column(0).to_numpy().view(np.uint64)
        yield shared.slim(np.concatenate([keys, keys]), bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for sizes, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                quoted = np.zeros(sum(sizes), bool)
                for run in runs:
                    quoted[run["at"] : run["at"] + run["n"] + LONG - 1] = True
                found.append(_restored(sizes, quoted))
            yield pa.record_batch([batch.column(0), *map(pa.array, np.array(found, np.int64).reshape(-1, 2).T)], names=["key", "n_shared", "n_restored"])

    def split(share: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Pages whose articles may share words, or the others."""

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array((shared.marked(sharing.value, batch.column(0).to_numpy().view(np.uint64)) > 0) == share))

        return take

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for chunk in _streams(batch.column(5), batch.column(2)):
                windows = _windows(chunk.hashes)
                for d, (a, b) in enumerate(zip(chunk.first[:-1], chunk.first[1:])):
                    own, place, stream, held, n = (batch.column(c)[chunk.row + d].as_py() for c in (3, 4, 5, 6, 7))
                    at = np.flatnonzero(np.isin(windows[a : max(a, b - LEAST + 1)], np.array(held or [], np.int64)))
                    covered = np.zeros(b - a, bool)
                    covered[(at[:, None] + np.arange(LEAST)).ravel()] = True
                    text, loose = _kept(own, place, stream, covered)
                    texts.append(text)
                    counts.append(loose + n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), batch.column(8)], names=["page_id", "url", "text", "n_shared", "n_restored"])

    spark = pages.sparkSession
    bits = shared.bucket_bits(spark)
    host = host_and_path(F.col(url))[0]
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    folder = shared.workspace(spark)
    parsed = shared.written(rows.mapInArrow(parse, PARSED), f"{folder}/parsed", "zstd")
    repeated = shared.written(_repeated(parsed), f"{folder}/repeated")
    parsed = parsed.withColumns({"hash": F.xxhash64("host"), "key": F.xxhash64("host", "owner")})
    runs = shared.written(_quoted(parsed.select("hash", "key", "text")), f"{folder}/quoted")
    sharing = spark.sparkContext.broadcast(shared.shared_bitmap(runs.select("key").distinct().mapInArrow(lambda batches: shared.each(batches, twice), shared.BLOCKS), bits, PAGE_BITS, owned=False))
    quoted = runs.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("runs")).join(parsed.select("key", "sizes"), "key").select("key", "sizes", "runs")
    counts = shared.written(quoted.mapInArrow(count, f"key long, {COUNTS}").dropDuplicates(["key"]), f"{folder}/counts")
    asked = parsed.where("own is not null")
    windows = asked.select("key", "hash", "stream").mapInArrow(ask, "key long, windows array<long>").select("key", F.explode("windows").alias("window"))
    held = windows.join(repeated, "window", "left_semi").groupBy("key").agg(F.collect_set("window").alias("held"))  # a page's own windows
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_shared", "n_restored")]
    texts = parsed.where("own is null").select("key", "page_id", "url", "text")
    done = texts.mapInArrow(split(False), texts.schema).select("page_id", "url", "text", *(F.lit(0).cast("long").alias(c) for c in ("n_shared", "n_restored")))
    checked = texts.mapInArrow(split(True), texts.schema).join(counts, "key", "left").select("page_id", "url", "text", *none)
    asked = asked.select("key", "page_id", "url", "hash", "own", "place", "stream").join(held.join(counts, "key", "full"), "key", "left")
    decided = asked.select("page_id", "url", "hash", "own", "place", "stream", "held", *none).mapInArrow(decide, f"page_id long, url string, text string, {COUNTS}")
    found = done.union(checked).union(decided)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), host.alias("host"), "n_shared", "n_restored")
