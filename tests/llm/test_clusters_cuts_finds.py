"""Centroid clustering, fill-in-middle and personal data: brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motioncheck.llm import centroids, infill, personal

CLASHES = ["id", "v", "n", "of", "text", "cluster", "distance", "form", "output", "spans", "h", "cell", "limb", "x"]


def with_clashes(df, *but):
    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in but})


def lloyd(vectors: list[tuple], k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64):
    """Over all rows, in Python's integers."""
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and math.isfinite(1024 * x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in usable if i is not None)
    c = [v for _, v in order[:k]]
    if not c:
        return []
    far = lambda v, m: sum((x - y) ** 2 for x, y in zip(v, m))
    near = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in usable]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(usable, of) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in usable]
    fits = lambda x: x if x < 2**63 else None
    inertia = [sum(d for d, o in last if o == j) for j in range(len(c))]
    return [(i, j, fits(d), fits(inertia[j]), fits(sum(inertia)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(usable, last)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(n: int, seed: int):
    rng = random.Random(seed)
    made = [(i, [rng.gauss(rng.choice((-1, 0, 2)), 0.3) for _ in range(64)]) for i in range(n)]
    made += [(n + i, made[0][1]) for i in range(60)] + [(n + 100 + i, made[i % 3][1]) for i in range(9)] + [made[4]]
    return made + [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] + [0.0] * 63), (906, [math.inf] * 64), (None, [0.5] * 64), (None, None), (907, [-0.0] * 64), (908, [0.0] * 64)]


@pytest.mark.parametrize("hot", [centroids.HOT, 5])
def test_clusters(spark, hot):
    """Copies, hot or not, and rows that can't be used."""
    made = vectors(150, 1)
    df = with_clashes(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
    assert rows_of(centroids.cluster_vectors(df, hot=hot)) == sorted(lloyd(made), key=str)


def test_clusters_of_any_size(spark):
    """Components beyond 16 bits, beyond 2 ** 53 and beyond longs are exact; what doesn't fit a long is null."""
    rng = random.Random(2)
    made = [(i, [rng.uniform(-1, 1) * scale for _ in range(64)]) for i, scale in enumerate([1, 1, 50, 1e3, 1e6, 1e6, 1e12, 1e12, 1e15, 1e30, 1e30, 1e300, 1e308] * 2)]
    found = rows_of(centroids.cluster_vectors(spark.createDataFrame(made, "vec_id long, embedding array<double>")))
    assert found == sorted(lloyd(made), key=str) and any(r[2] is None for r in found) and any(r[2] is not None for r in found)


def test_few_and_no_vectors(spark):
    made = vectors(9, 3)[:3] + [(1, vectors(9, 4)[8][1])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    assert len(rows_of(centroids.cluster_vectors(df))) == 4
    assert rows_of(centroids.cluster_vectors(df.where("false"))) == [] and rows_of(centroids.cluster_vectors(df.withColumn("vec_id", F.lit(None).cast("long")))) == []
    assert centroids.cluster_vectors(df.where("false")).columns == centroids.cluster_vectors(df).columns
    same = spark.createDataFrame([(i, [0.25] * 64) for i in range(20)], "vec_id int, embedding array<float>")
    assert {tuple(r)[1:5] for r in centroids.cluster_vectors(same).collect()} == {(0, 0, 0, 0)}


def test_limbs():
    for x in (0, 1, -1, 2**48, -(2**48) - 5, 3**200, -(7**90)):
        assert sum(d << (48 * i) for i, d in enumerate(centroids.limbs(x))) == x


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut(text: str | None, id: int | None):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or id is None or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = st.text(st.sampled_from("ab <>PSM\t\n\v\f\r\x1c\x00é日\U0001f600　 \x85"), max_size=60)


@given(TEXTS, st.integers(0, 10**6))
@settings(max_examples=1500, deadline=None)
def test_cut_is_exact(text, id):
    data = text.encode()
    found = infill.transform(data, id)
    assert (*found[:4], found[4].decode()) == cut(text, id)
    assert infill.restore(found[4], found[1]) == data


@given(st.integers(0, 2**300), st.integers(0, 40))
def test_ranked_bits(bits, more):
    width = bits.bit_length() + more
    places = [i + 1 for i, c in enumerate(format(bits, f"0{width}b") if width else "") if c == "1"]
    assert [infill.ranked(bits, width, k + 1) for k in range(len(places))] == places and infill.ranked(bits, width, 0) == 0


def test_fill_in_middle(spark):
    long = "wörd \t" * 300_000
    made = [(i, f"text of {i} words\nand <more>  " * (i % 7)) for i in range(300)] + [(7, "again"), (7, "again"), (300, None), (301, ""), (302, "a <S> b"), (None, "no id"), (None, None), (303, " \n "), (304, long), (305, long), (306, long)]
    df = with_clashes(spark.createDataFrame(made, "doc_id long, text string"), "text")
    found = rows_of(infill.fill_in_middle(df))
    assert found == sorted([(i, *cut(t, i)) for i, t in made], key=str)
    assert {r[2] for r in found} == {"plain", "spm", "psm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = rows_of(infill.fill_in_middle(df, digests=True))
    assert digests == sorted([(i, *cut(t, i)[:4], sha(cut(t, i)[4]), sha(t or "")) for i, t in made], key=str)
    back = infill.restored(infill.fill_in_middle(df))
    assert sorted(((r.doc_id, r.restored) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in made), key=str)
    assert infill.fill_in_middle(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, marks=("<P>", "<P>x", "<M>"))


def plain(text: str):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and personal.luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }


@given(st.one_of(st.text(st.sampled_from("ab@.-+ 01_%(é"), max_size=50), st.text(st.sampled_from("0123456789.. -+"), max_size=70), st.from_regex(r"(\+?[0-9]{1,4}[ .@-]){0,9}x@y\.z", fullmatch=True)))
@settings(max_examples=3000, deadline=None)
def test_base_is_the_plain_patterns(text):
    assert personal.base_spans(text) == plain(text)
    base, added = personal.spans(text)
    assert base == plain(text)


def found_in(text: str):
    base, added = personal.spans(text)
    return sorted((k, text[a:b]) for found in (base, added) for k, own in found.items() for a, b in own)


@pytest.mark.parametrize(
    "text,want",
    [
        ("mail john dot doe at example dot com now", [("email", "john dot doe at example dot com")]),
        ("ok john(at)example(dot)com!", [("email", "john(at)example(dot)com")]),
        ("é john [at] example.com, é", [("email", "john [at] example.com")]),
        ("ana arroba correo punto es", [("email", "ana arroba correo punto es")]),
        ("x&#64;y&#46;org", [("email", "x&#64;y&#46;org")]),
        ("to john@example dot com", [("email", "john@example dot com")]),
        ("ｊｏｅ＠ｍａｉｌ．ｃｏｍ", [("email", "ｊｏｅ＠ｍａｉｌ．ｃｏｍ")]),
        ("is jоhn@example.com", [("email", "hn@example.com"), ("email", "jоhn@example.com")]),
        ("a j​o@ex​ample.com b", [("email", "j​o@ex​ample.com")]),
        ("call plus four nine one five one two three four five six seven ok", [("phone", "plus four nine one five one two three four five six seven")]),
        ("call +1 (555) five five five double one 0 six ok", [("phone", "+1 (555) five five five double one 0 six")]),
        ("١٢٧.0.0.١", [("ip", "١٢٧.0.0.١")]),
        ("at one nine two dot one six eight dot one dot one", [("ip", "one nine two dot one six eight dot one dot one")]),
        ("eins punkt zwei punkt drei punkt vier", [("ip", "eins punkt zwei punkt drei punkt vier")]),
        ("192 dot 168 dot 1 dot 20 up", [("ip", "192 dot 168 dot 1 dot 20")]),
        ("4111–1111–1111–1111", [("card", "4111–1111–1111–1111")]),
        ("four one one one 1111 1111 one one one one.", [("card", "four one one one 1111 1111 one one one one")]),
        ("see us at example.com dot", []),
        ("a@b.com dot product", [("email", "a@b.com")]),
        ("the one two three, and at noon. dot", []),
        ("Meet me at noon; connect the dot. One at a time, two by two, plus one.", []),
        ("Привет, мир. Как дела у вас?", []),
    ],
)
def test_disguises(text, want):
    assert found_in(text) == want
    assert found_in(f"日​ x {text}") == want


def test_clean_documents_gain_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert personal.find_personal(docs).where("n_added > 0").count() == 0


def test_find_personal(spark):
    made = [(1, "me@x.org, 10.0.0.1 \U0001f600 +49 (30) 1234-567 and 4111 1111 1111 1111"), (1, "me@x.org"), (2, None), (3, ""), (None, "é a at b dot cd"), (4, "a@b.c " * 200_000), (5, "one " * 100_000), (6, "9" * 3_000)]
    df = with_clashes(spark.createDataFrame(made, "doc_id long, text string"), "text")
    found = rows_of(personal.find_personal(df))
    want = []
    for i, text in made:
        own = plain(text or "")
        order = sorted((a, personal.KINDS.index(k), b) for k, spans in own.items() for a, b in spans)
        base = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in order)
        extra = ["email:2:15"] if i is None else []
        want.append((i, *(len(own[k]) for k in personal.KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(filter(None, [base, *extra])), len(extra)))
    assert found == sorted(want, key=str)
    assert personal.find_personal(df.where("false")).count() == 0
    hidden = personal.masked(df)
    assert hidden.columns == df.columns and sorted(str(r.text)[:40] for r in hidden.where("doc_id in (1, 2, 3)").collect()) == ["", "<EMAIL>", "<EMAIL>, <IP> \U0001f600 <PHONE> and <CARD>", "None"]
    assert [r.text for r in hidden.where("doc_id is null").collect()] == ["é <EMAIL>"]
