"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motioncheck.llm.shared import ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.ngram_join import ngram_groups

    return ngram_groups(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.html_text import main_texts

    return main_texts(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_shared", "n_restored")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.substring import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the chain flags as toxic."""
    from motioncheck.llm.toxicity import toxic_documents

    return toxic_documents(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.packing import default_vocabulary, pack

    return pack(_table(spark, sf_dir, "documents"), default_vocabulary())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.langid import default_pieces, fit, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, default_pieces()))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    from motioncheck.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.urls import filter_urls, labelled_outcomes

    pages = _table(spark, sf_dir, "pages")
    return filter_urls(pages, labelled_outcomes(pages, _table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.warc import archived

    return archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.centroids import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.infill import fill_in_middle

    return fill_in_middle(_table(spark, sf_dir, "documents"), digests=True)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motioncheck.llm.personal import find_personal

    return find_personal(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_ngram_join, op2_html_extraction, op3_substring_dedup, op4_language_id, op5_decontamination, op6_url_filters, op7_toxicity,
        op8_packing, op9_warc, op10_neighbours, op11_centroid_clustering, op12_fill_in_middle, op13_pii,
    )
    return {f.__name__: f for f in own}


#: A word shingle of op1 is a list of words; links, then the smallest id within reach.
_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n, sh FROM s),
u AS (SELECT min(doc_id) AS id, list_sort(sh) AS sh, any_value(n) AS n FROM n WHERE n > 0 GROUP BY list_sort(sh)),
t AS (SELECT id, n, unnest(sh) AS g FROM u),
p AS (
  SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.g = b.g AND a.id < b.id
  WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id, id AS c FROM u UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
l AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(l.c, n.doc_id) AS component_id
FROM n LEFT JOIN u ON list_sort(n.sh) = u.sh LEFT JOIN l ON l.id = u.id
"""


#: Each window's least document; a word goes if a window that covers it starts in a smaller one.
_OP3 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM g),
m AS (SELECT win, min(doc_id) AS least FROM k GROUP BY win),
c AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 13)) AS p FROM k JOIN m ON k.win = m.win AND m.least < k.doc_id),
r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id
"""


#: Counts per host, domain and suffix; each level's prior is the mean of the level above, with one strength by moments; the bound is an integral over the logit.
_OP6 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 0 END) AS bad FROM labels GROUP BY doc_id),
o AS (
  SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS name
  FROM p JOIN l ON try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html|/)?$', 1), '') AS BIGINT) = l.doc_id WHERE bad IS NOT NULL GROUP BY host),
q AS (SELECT *, string_split(name, '.') AS labels FROM o),
c AS (SELECT *, regexp_matches(name, '^[0-9.]+$|^\[') OR len(labels) = 1 AS whole,
  CASE WHEN len(labels) >= 2 AND length(labels[-1]) = 2 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gov', 'gouv', 'ltd', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'plc', 'sch') THEN 2 ELSE 1 END AS w FROM q),
h0 AS (SELECT host, n, k, CASE WHEN whole THEN name ELSE array_to_string(labels[-(w + 1):], '.') END AS domain, CASE WHEN whole THEN name ELSE array_to_string(labels[-w:], '.') END AS suffix FROM c),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h0 GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
s1 AS (SELECT *, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) AS m FROM s),
sr AS (SELECT greatest(2.0, least(200.0, CASE WHEN r > 0 THEN 1 / r - 1 ELSE 200.0 END)) AS t FROM
  (SELECT CASE WHEN sum(m * (1 - m) * n * (n - 1)) > 0 THEN (sum((k - n * m) * (k - n * m)) - sum(m * (1 - m) * n)) / sum(m * (1 - m) * n * (n - 1)) ELSE 0 END AS r FROM s1)),
s2 AS (SELECT suffix, (m * t + k) / (t + n) AS prior FROM s1, sr),
d1 AS (SELECT d.*, prior AS m FROM d JOIN s2 USING (suffix)),
dr AS (SELECT greatest(2.0, least(200.0, CASE WHEN r > 0 THEN 1 / r - 1 ELSE 200.0 END)) AS t FROM
  (SELECT CASE WHEN sum(m * (1 - m) * n * (n - 1)) > 0 THEN (sum((k - n * m) * (k - n * m)) - sum(m * (1 - m) * n)) / sum(m * (1 - m) * n * (n - 1)) ELSE 0 END AS r FROM d1)),
d2 AS (SELECT domain, suffix, (m * t + k) / (t + n) AS prior FROM d1, dr),
h1 AS (SELECT h0.*, prior AS m FROM h0 JOIN d2 USING (domain, suffix)),
hr AS (SELECT greatest(2.0, least(200.0, CASE WHEN r > 0 THEN 1 / r - 1 ELSE 200.0 END)) AS t FROM
  (SELECT CASE WHEN sum(m * (1 - m) * n * (n - 1)) > 0 THEN (sum((k - n * m) * (k - n * m)) - sum(m * (1 - m) * n)) / sum(m * (1 - m) * n * (n - 1)) ELSE 0 END AS r FROM h1)),
h2 AS (SELECT host, m * t + k AS a, (1 - m) * t + n - k AS b FROM h1, hr),
g AS (SELECT host, x, y, ln(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - r1 AS di, 1 / z + 1 / (2 * z ** 2) + 1 / (6 * z ** 3) - 1 / (30 * z ** 5) + r2 AS tri FROM
  (SELECT *, y + 6 AS z, list_sum([1 / (y + i) for i in range(0, 6)]) AS r1, list_sum([1 / (y + i) ** 2 for i in range(0, 6)]) AS r2 FROM
    (SELECT host, 'a' AS x, a AS y FROM h2 UNION ALL SELECT host, 'b', b FROM h2))),
e AS (SELECT ga.host, ga.y AS a, gb.y AS b, ga.di - gb.di AS mean, sqrt(ga.tri + gb.tri) AS dev, a * ln(a / b) - (a + b) * ln(1 + a / b) AS peak FROM g ga JOIN g gb ON ga.host = gb.host AND ga.x = 'a' AND gb.x = 'b'),
z AS (SELECT *, 'low' AS part, mean - 10 * dev AS u0, least(mean + 10 * dev, greatest(mean - 10 * dev, 0e0)) AS u1 FROM e UNION ALL SELECT *, 'high', least(mean + 10 * dev, greatest(mean - 10 * dev, 0e0)), mean + 10 * dev FROM e),
i AS (SELECT host, part, (u1 - u0) / 200 * list_sum([CASE WHEN k IN (0, 200) THEN 0.5e0 ELSE 1e0 END * exp(a * (u0 + k * (u1 - u0) / 200) - (a + b) * ln(1 + exp(u0 + k * (u1 - u0) / 200)) - peak) for k in range(0, 201)]) AS mass FROM z),
h3 AS (SELECT host, sum(mass) FILTER (part = 'high') / sum(mass) AS bound FROM i GROUP BY host),
f AS (
  SELECT p.*, bound, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'block example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'block example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'block com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'allow com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'allow org/' END AS r
  FROM p LEFT JOIN h3 USING (host))
SELECT page_id, host, path, r[7:] AS rule, CASE WHEN r IS NOT NULL THEN r[:5] WHEN bound > 0.975 THEN 'block' ELSE 'allow' END AS verdict FROM f
"""

#: What reading the archives must find.
_OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN last > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last > p.page_id THEN last END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes = m.payload_bytes
"""


#: Ten rounds over all rows, none grouped: k has the vectors, c0 the first centroids, d1 to d10 distances, c1 to c10 what they lead to, d11 the last assignment.
_OP11 = (
    """
WITH k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM k WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id), v LIMIT 8)"""
    + "".join(
        f""",
d{i} AS MATERIALIZED (
  SELECT vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}}) AS n
  FROM (SELECT *, row_number() OVER () AS r FROM k), c{i - 1} GROUP BY r, vec_id, v),
c{i} AS MATERIALIZED (
  SELECT o.c, coalesce(x.m, o.m) AS m FROM c{i - 1} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m
    FROM (SELECT n.c AS c, p, sum(v[p]) AS s, count(*) AS n FROM d{i}, range(1, 65) t(p) GROUP BY n.c, p) GROUP BY c) x ON x.c = o.c)"""
        for i in range(1, 11)
    )
    + """,
d11 AS (
  SELECT vec_id, min({'d': list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}) AS n
  FROM (SELECT *, row_number() OVER () AS r FROM k), c10 GROUP BY r, vec_id, v)
SELECT vec_id, n.c::INTEGER AS cluster, n.d::BIGINT AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM d11 JOIN c10 ON n.c = c10.c
"""
)

#: Tokens as a list, pieces as parts of it; what is restored must be the text.
_OP12 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts, sha256('42:' || doc_id) AS h FROM documents),
n AS (SELECT *, len(ts)::BIGINT AS n, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT for i in range(0, 4)] AS hs FROM t),
f AS (
  SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
    CASE WHEN h IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50 THEN 'plain' WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(ts[1:a], '') AS pre, array_to_string(ts[a + 1:b], '') AS mid, array_to_string(ts[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _OP1, "op3_substring_dedup": _OP3, "op6_url_filters": _OP6, "op9_warc": _OP9, "op11_centroid_clustering": _OP11, "op12_fill_in_middle": _OP12}
