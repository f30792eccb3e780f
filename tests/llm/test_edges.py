"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motioncheck.llm import decontam, html_text, langid, neighbours, ngram_join, packing, shared, substring, toxicity, urls, warc

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
SAME = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"

ROWS = [
    (1, SAME, "en", "a", 5),
    (1, SAME, "en", "a", 5),
    (2, SAME, None, None, None),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n ", "de", "a", 3),
    (6, "too few", "en", "b", 7),
    (7, "Too Few", "en", "b", 7),
    (8, LONG, "en", "c", len(LONG)),
    (9, LONG, "en", "c", len(LONG)),
    (None, SAME, "en", "a", 1),
    (None, None, None, None, None),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ["id", "key", "label", "hashes", "n", "links", "ranges", "kept", "own_key", "h", "item_id", "of", "copies", "_kept", "_held", "shard", "block", "query", "v", "host", "path", "rule", "payload", "value", "keep_0"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_ngram_groups(docs, none):
    found = sorted([tuple(r) for r in ngram_join.ngram_groups(docs).select("doc_id", "n_shingles", "component_id").collect()], key=str)
    assert found == sorted([(1, 10, 1), (1, 10, 1), (2, 10, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, found_n(LONG), 8), (9, found_n(LONG), 8), (None, 10, None), (None, 0, None)], key=str)
    assert ngram_join.ngram_groups(none).count() == 0


def found_n(text: str) -> int:
    words = text.lower().split()
    return len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_keep_one(spark, docs):
    kept = ngram_join.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "3", "4", "5", "6", "8", "None", "None"]


def test_dedup_substrings(docs, none):
    found = {}
    for r in substring.dedup_substrings(docs, keep=("lang", "keep_0")).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
        assert r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()
    # words that repeat within one document don't repeat another's
    assert found == {1: [(14, 0)] * 2, 2: [(14, 14)], 3: [(0, 0)], 4: [(0, 0)], 5: [(0, 0)], 6: [(2, 0)], 7: [(2, 0)], 8: [(60_000, 0)], 9: [(60_000, 60_000)], None: [(14, 0), (0, 0)]} or found[None] == [(0, 0), (14, 0)]
    assert substring.dedup_substrings(none).count() == 0
    with pytest.raises(ValueError):
        substring.dedup_substrings(docs, width=8)


def test_language(docs, none):
    pieces = langid.default_pieces()
    model = langid.fit(docs, pieces)
    found = [tuple(r) for r in langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score").collect()]
    assert len(found) == len(ROWS)
    by = {r[0]: r for r in found if r[0] is not None}
    for i in (3, 4, 5):
        assert by[i][2:] == ("und", 0.0)
    assert all(by[i][1] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by)
    assert all(0 <= r[3] <= 1 for r in found)
    empty = langid.fit(none, pieces)
    assert langid.identify(none, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    kept = langid.in_learned_languages(docs, model)
    assert kept.columns == docs.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert langid.in_learned_languages(docs, empty).count() == 0 and langid.in_learned_languages(none, model).count() == 0


def test_language_learns_whole_texts(spark):
    """Words far beyond any prefix and of any length are learned from."""
    far, long = "zyx " * 30, "qv" * 5000
    rows = [(i, "common words " * 4000 + far + long, "xx") for i in range(30)] + [(100 + i, "other kind of text " * 50, "yy") for i in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["▁", "zyx", "▁zyx", "qv", "common", "▁common", "words", *"abcdefghijklmnopqrstuvwxyz"])
    found = dict(zip(model.pieces.pieces, model.probability[:, model.languages.index("xx")]))
    assert found["▁zyx"] > 1e-4 and found["qv"] > 0.1


def test_language_stage_rejects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 90))) for _ in range(40)]
    odd += ["日本語のテキストです。 これは学習されていない言語です。 " * 3, "Это текст на русском языке который не изучался моделью", "12 34 --", "x1 y2 z3 q9 k7 " * 9]
    german = docs.where("lang = 'de'").count()
    some = docs.where("lang <> 'de'").select("doc_id", "text", "lang")
    taught = langid.fit(some, langid.default_pieces())
    left = langid.in_learned_languages(docs.select("doc_id", "text", "lang"), taught).groupBy("lang").count().collect()
    left = {r["lang"]: r["count"] for r in left}
    assert left.get("de", 0) <= 0.02 * german and sum(n for k, n in left.items() if k != "de") >= 0.995 * some.count()
    mixed = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in langid.keep_identified(spark, mixed, "").select("doc_id").collect()}
    assert not {i for i in kept if i >= 10**6} and len(kept) >= 0.998 * docs.count()


def test_contaminated(spark, docs, none):
    items = spark.createDataFrame([(10, SAME), (11, None), (12, ""), (13, "too few"), (10, SAME)], "item_id long, text string")
    found = sorted({(str(r.doc_id), r.item_id, r.similarity) for r in decontam.contaminated(docs, items).collect()})
    assert found == [("1", 10, 1.0), ("2", 10, 1.0), ("6", 13, 1.0), ("7", 13, 1.0), ("None", 10, 1.0)]
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs, items.where("false")).count() == 0
    clean = decontam.without(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["3", "4", "5", "8", "9", "None"]


def test_toxicity(spark, docs, none):
    texts = [(i, f"plain words here {i % 5}" + " vile" * (i % 4 == 0)) for i in range(200)]
    own = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES})
    marks = spark.createDataFrame([(i, 0 if i % 7 == 0 else 1, int(i % 4 == 0)) for i in range(150)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id for r in toxicity.toxic_documents(spark, own, marks).collect()}
    assert found == {i for i in range(200) if i % 4 == 0}
    chain = toxicity.fit(docs, marks.where("false"), {"a": F.col("toxic")})
    assert chain.categories == ["a"]
    assert toxicity.classify(docs, chain).count() == len(ROWS)
    assert toxicity.classify(none, chain).count() == 0
    assert toxicity.toxic_documents(spark, none, marks).count() == 0
    assert toxicity.toxic_documents(spark, own, marks.where("false")).count() == 0


def test_language_samples_of_null_texts(spark):
    # texts that are null take no place in the sample, however many there are, and a language of null texts isn't learned
    rows = [(i, None if i % 20 else f"wort zahl {i}", "de") for i in range(2000)] + [(i, f"word number {i}", "en") for i in range(2000, 2300)] + [(i, None, "fr") for i in range(2300, 2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = ["▁", *"abcdefghijklmnopqrstuvwxyz0123456789", "▁wort", "▁word", "▁number", "▁zahl"]
    model, plain = (langid.fit(d, pieces, sample=20) for d in (docs, docs.where("text is not null")))
    assert model.languages == plain.languages == ["de", "en"]
    assert np.array_equal(model.probability, plain.probability)


def test_packing(docs, none):
    vocabulary = packing.default_vocabulary()
    rows = packing.pack(docs, vocabulary).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert {r.doc_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    assert sum(r.length for r in rows if r.doc_id == 8) == next(r.doc_tokens for r in rows if r.doc_id == 8)
    assert packing.pack(none, vocabulary).count() == 0


PAGES = "page_id long, url string, html string"
BIG = "<p>" + "long text " * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nno record</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://A.example.org/es/1", BIG), (2, "http://b.example.com/de/", BIG), (2, "http://b.example.com/de/", BIG), (3, None, None), (4, "no scheme", ""), (None, "x://h/p?q", "<p>a\r\n\r\nb"), (5, "http://h\r\nX: y/", "text only"), (6, "http://h/é", "é" * 600), (7, "http://h/", "é" * 600)]
    return spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("clash") for c in CLASHES})


def test_archives(pages):
    found = sorted(((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.archived(pages).collect()), key=str)
    n = len(BIG.encode())
    assert found == sorted([("1", "revisit", 2, n), ("2", "response", None, n), ("2", "response", None, n), ("3", "response", None, 0), ("4", "response", None, 0), ("None", "response", None, 9), ("5", "response", None, 9), ("6", "revisit", 7, 1200), ("7", "response", None, 1200)], key=str)
    whole = {r.page_id: r for r in warc.archived(pages.where("page_id > 1")).collect()}
    assert whole[2].payload == BIG and whole[2].payload_digest == hashlib.sha1(BIG.encode()).hexdigest()
    assert warc.archived(pages.where("false")).count() == 0


def test_every_reference_is_a_record(spark, pages):
    """Also where the response's row is repeated, and where all rows of a group are."""
    more = spark.createDataFrame([(i, f"http://h/{k}", "q" * 1500) for i, k in [(20, 0), (21, 1), (22, 2), (22, 2), (22, 3), (20, 0)]], PAGES)
    for own in (pages.unionByName(more, allowMissingColumns=True), pages.unionByName(more, allowMissingColumns=True).repartition(5)):
        path = shared.workspace(spark)
        warc.write_archives(own, path)
        raw = "".join(bytes(r.content).decode() for r in spark.read.format("binaryFile").load(path).collect())
        ids, to = re.findall("WARC-Record-ID: (.*)\r\n", raw), re.findall("WARC-Refers-To: (.*)\r\n", raw)
        assert len(ids) == len(set(ids)) and len(to) >= 5 and set(to) <= set(ids)


PIECES = ["WARC/1.1\r\n", "\r\n", "\r\n\r\n", "WARC-Type: ", "WARC", "/1.1\r\n", "WARC-Type:", "x", "", "é", "response\r\n", "Content-Length: 3\r\n", "\n", "\r", " "]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_archives_keep_every_page(spark, split):
    rng = random.Random(9)
    texts = ["WARC/1.1\r\nx", "abc", "\r\nWARC/1.1\r\n", "x\r\n\r\nWARC/1.1", warc.MARK, warc.MARK * 3, "WARC/1.1", "WARC", "\r\n\r\n", "\r\n", warc.MARK[:-1], "W" + warc.MARK]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(300)] + [warc.MARK + "y" * 2000] * 3
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)] + [(0, "http://h/0", texts[0]), (0, "http://h/0", texts[0]), (None, None, warc.MARK), (None, None, warc.MARK)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = shared.workspace(spark)
    warc.write_archives(pages, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = sorted(((r.page_id, r.url, r.payload, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    last = len(texts) - 1
    assert found == sorted([(i, u, None, "revisit", last) if i in (last - 1, last - 2) else (i, u, t, "response", None) for i, u, t in rows], key=str)


def test_archives_are_warc(spark, pages):
    """Records by their own Content-Length, as other readers take them."""
    path = shared.workspace(spark)
    rows = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate([warc.MARK * 2, "z" * 1500, "z" * 1500, None, "é", "é"])] + [(4, "http://h/4", "é")] * 2, PAGES)
    warc.write_archives(rows, path, date="2024-01-02T03:04:05Z")
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    at, records = 0, []
    while at < len(raw):
        head = raw[at : raw.index(b"\r\n\r\n", at)].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in head[1:])
        begin = at + len("\r\n".join(head).encode()) + 4
        end = begin + int(fields["Content-Length"])
        assert head[0] == "WARC/1.1" and raw[end : end + 4] == b"\r\n\r\n" and fields["WARC-Date"] == "2024-01-02T03:04:05Z"
        records.append((fields, raw[begin:end]))
        at = end + 4
    ids = [f["WARC-Record-ID"] for f, _ in records]
    assert len(set(ids)) == len(ids) == 8 + 2  # one page is three segments
    by = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    revisit = next(f for f, _ in records if f["WARC-Type"] == "revisit")
    assert by[revisit["WARC-Refers-To"]][1].endswith(b"z" * 1500) and by[revisit["WARC-Refers-To"]][0]["WARC-Page-ID"] == "2"
    parts = sorted((int(f["WARC-Segment-Number"]), f, b) for f, b in records if "WARC-Segment-Number" in f)
    assert b"".join(b for _, _, b in parts).endswith(b"\r\n\r\n" + (warc.MARK * 2).encode()) and {f["WARC-Segment-Origin-ID"] for _, f, _ in parts[1:]} == {parts[0][1]["WARC-Record-ID"]}
    assert int(parts[-1][1]["WARC-Segment-Total-Length"]) == sum(len(b) for _, _, b in parts)


def test_urls(spark, pages):
    outcomes = spark.createDataFrame([("h", 1)] * 40 + [("good", 0)] * 40 + [(None, 1), ("h", None)], "host string, bad int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, outcomes).collect() if r.page_id}
    assert found[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert found[2] == ("b.example.com", "/de/", "com/de/", "block")
    assert found[3] == ("", "", None, "allow") and found[4] == ("", "", None, "allow")
    assert found[7] == ("h", "/", None, "block")
    assert urls.filter_urls(pages.where("false"), outcomes).count() == 0
    assert urls.filter_urls(pages, outcomes.where("false")).where("verdict = 'block'").count() == 3


def test_registered_domains(spark):
    hosts = {"a.co.uk": ("a.co.uk", "co.uk"), "x.b.co.uk": ("b.co.uk", "co.uk"), "www.example.com": ("example.com", "com"), "user@www.example.com:8080": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "localhost": ("localhost", "localhost"), "": ("", ""), "co.uk": ("co.uk", "co.uk"), "t.co": ("t.co", "co"), "example.com.": ("example.com", "com")}
    domain, suffix = urls.domain_and_suffix(F.col("host"))
    assert {r.host: (r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_posterior_probabilities(spark):
    """Those of draws, for few and many outcomes."""
    rng = random.Random(1)
    for a, b, limit in ((30.0, 10.0, 0.6), (5.0, 2.0, 0.36), (300.0, 200.0, 0.57), (0.2, 1.5, 0.01), (2.0, 0.3, 0.5), (1.0, 1.0, 0.3), (40.0, 1.0, 0.5)):
        draws = [rng.betavariate(a, b) for _ in range(100_000)]
        found = spark.range(1).select(urls.surely_above(F.lit(a), F.lit(b), limit).alias("p")).first().p
        assert abs(found - sum(x > limit for x in draws) / len(draws)) < 0.006, (a, b, limit, found)


def test_stages_keep_all_columns(spark, docs, none):
    """Nulls, empty and long texts, repeated rows, clashing and missing columns in each stage of the pipeline."""
    few = docs.select("doc_id", "text", F.lit("x").alias("n_words"))
    for own in (docs, few, docs.drop("lang").withColumn("lang", F.lit("en"))):
        kept = substring.keep_unique(spark, own, "")
        assert kept.columns == own.columns and kept.dtypes == own.dtypes
        texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert texts == sorted(((r[0], r[1]) for r in ROWS if r[0] not in (2, 9)), key=str)  # 2 and 9 are wholly repeated
    for stage in (langid.keep_identified, ngram_join.keep_one, substring.keep_unique):
        assert stage(spark, none, "").count() == 0
    assert langid.keep_identified(spark, docs, "").columns == docs.columns
    assert packing.packed(spark, none, "").count() == 0 and packing.packed(spark, docs, "").count() >= len(ROWS)


def test_main_texts(pages):
    found = [(r.page_id, r.text, r.n_chars) for r in html_text.main_texts(pages).collect()]
    assert len(found) == 9 and (3, "", 0) in found and (4, "", 0) in found and (5, "text only", 9) in found
    assert (None, "a b", 3) in found
    assert html_text.main_texts(pages.where("false")).count() == 0


def test_neighbours(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, float("inf")]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in CLASHES})
    found = sorted(tuple(r) for r in neighbours.nearest(df).collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0)]
    assert neighbours.nearest(df.where("false")).count() == 0


def test_neighbours_of_repeated_ids_and_vectors(spark):
    """One vector with most rows; ids with two vectors, as candidates and as queries."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [3.0, 1.0, float(i)]) for i in range(20)] + [(50, [3.0, 1.0, 4.0]), (1003, [1.0, 2.0, 3.0]), (1003, [1.0, 2.0, 3.0])]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert found[0] == [(i, 1.0) for i in (1, 2, 3, 4, 5)]
    # by its second vector 50 is near 1004 too; the cosines of equal vectors differ in their last bits
    assert {x for _, x in found[50]} == {1.0} and {i for i, _ in found[50]} <= {0, 1, 2, 3, 4, 1004}
    assert found[100] == [(i, 1.0) for i in (0, 1, 2, 3, 4)] and len(found) == 7


def test_slim_blocks_keep_what_marks_and_levels_ask():
    draw = np.random.default_rng(5)
    hashes, owners, times = draw.integers(0, 1 << 64, 4000, np.uint64), draw.integers(0, 1 << 64, 4000, np.uint64), draw.integers(1, 1 << 16, 4000)
    for bits in (4, 11, 18):
        made = shared.slim(hashes, bits, (owners, shared.OWNER), (times, 2))
        found = [np.concatenate(c) for c in zip(*(shared.unslim(bucket, [block], bits, shared.OWNER, 2) for bucket, block in zip(made.column(0).to_pylist(), made.column(1).to_pylist())))]
        order, kept = np.argsort(hashes, kind="stable"), np.uint64(64 - bits - 8 * shared.SLIM)
        assert (found[0] == hashes[order] >> kept << kept).all() and (found[1] == owners[order] & np.uint64((1 << 40) - 1)).all() and (found[2] == times[order]).all()
    # a post of the largest shuffle takes 9 bytes, 16 before
    posts = next(iter(shared.owners_packed(hashes, owners, 4)))
    assert sum(map(len, posts.column(1).to_pylist())) < 10 * len(hashes)
