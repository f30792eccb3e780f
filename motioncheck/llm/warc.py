"""WARC archives without repeated payloads: writing, reading back, and resolving revisits.

Method: revisit resolution. Only headers are shuffled: each record's payload digest and size,
by digest. Of equal large payloads one record is the response, and the others are written as
revisit records that refer to it, with fresh headers and no payload. Archives are written and
read by Spark's text source, on any file system, in parallel and committed task by task.

Archives are uncompressed WARC 1.1 by default, which any reader takes; Spark can compress a
file only as a whole, and readers want a gzip member for each record.

A file is parted into records where VERSION and the name of the first header stand together
(MARK). A payload that holds MARK goes out in segments, as the format provides. MARK can't be
made up of a payload and what stands around it: that is white space on both sides, and MARK
begins and ends with other characters but for its last, which follows a colon in it alone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncheck.llm import shared

#: Smaller payloads are always written whole.
LEAST = 1000
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
MARK = f"{VERSION}WARC-Type: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text; the block may be of any length, and headers with null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in headers]
    return F.concat(F.lit(f"{MARK}{kind}\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _urn(text: Column) -> Column:
    """A record id from a text that is one record's alone: its MD5 digest in the form of a UUID."""
    return F.regexp_replace(F.md5(F.encode(text, "UTF-8")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def resolve(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds record_type and refers_to to (page_id, payload_bytes, payload_digest, ...).

    Digests that appear once need no partner, so only a digest's largest id is joined back, and
    a digest with any number of rows is pre-aggregated, then joined by a join that Spark can split.
    """
    large = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    last = large.groupBy(F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("size")).agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    joined = rows.join(last, (rows.payload_digest == last.of) & (rows.payload_bytes == F.col("size")) & (rows.page_id < F.col("last")), "left")
    kind = F.when(F.col("last").isNull(), "response").otherwise("revisit")
    return joined.withColumn("record_type", kind).withColumn("refers_to", F.col("last")).drop("of", "size", "last", "copies")


def write_archives(pages: DataFrame, path: str, html: str = "html", id: str = "page_id", url: str = "url", least: int = LEAST, compression: str = "none", date: str | None = None) -> None:
    """Writes a record per page under path, as WARC text files; `date` is their WARC-Date (now if None).

    The payload is the html in UTF-8, behind the head of an HTTP response; null html is an empty
    payload. Pages that repeat an id are records like others: of equal payloads the rows with
    the largest id are responses. A null id is a response of its own. Record ids are unique; a
    page's follows from its id and payload, unless rows repeat both. Where a response's row is
    repeated, revisits are written after the responses, and refer to a record id that is read from the
    archive. Other columns are ignored,
    whatever their names; no rows make an archive with no records.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    heads = rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.encode("payload", "UTF-8")).alias("payload_digest"))
    # headers first: what refers where by id and digest, and which of these several rows have
    times = resolve(heads, least).groupBy(F.col("page_id").alias("from_id"), F.col("payload_digest").alias("from_digest"), "refers_to").agg(F.count("*").alias("times"))
    plan = shared.written(times.where("times > 1 or refers_to is not null"), f"{path.rstrip('/')}-plan")
    known = rows.withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))
    known = known.join(plan, known.page_id.eqNullSafe(plan.from_id) & (known.payload_digest == plan.from_digest), "left")

    name = lambda page: F.concat_ws(" ", F.lit("page"), F.coalesce(page.cast("string"), F.lit("none")), F.col("payload_digest"))
    # rows that repeat an id and a payload get ids that are unique in the table: these have a row's place in its task
    known = known.withColumn("record", F.when(F.coalesce("times", F.lit(1)) > 1, F.concat_ws(" ", name(F.col("page_id")), F.monotonically_increasing_id().cast("string"))).otherwise(name(F.col("page_id"))))
    now = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    full = F.col("payload")
    # a line break in a url would end its header
    common = [("WARC-Date", F.lit(now)), ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), ("WARC-Page-ID", F.col("page_id"))]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("WARC-Payload-Length", F.octet_length(full))]
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    own = ("WARC-Record-ID", _urn(F.col("record")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(full).cast("string"), F.lit(END))
    revisit = _record("revisit", [own, *common, *digest, ("WARC-Refers-To", F.col("origin")), ("WARC-Refers-To-Page-ID", F.col("refers_to")), ("WARC-Profile", F.lit(PROFILE))], F.lit(""))
    whole = _record("response", [own, *common, *digest, kind], F.concat(http, full))
    # each MARK in the payload is cut in two: after WARC
    parts = F.split(F.concat(http, full), "(?<=WARC)(?=/1\\.1\r\nWARC-Type: )")
    last = F.when(F.size(parts) > 0, F.octet_length(F.concat(http, full)))

    def segment(x: Column, i: Column) -> Column:
        number = ("WARC-Segment-Number", i + 1)
        first = _record("response", [own, *common, *digest, kind, number], x)
        after = [("WARC-Record-ID", _urn(F.concat_ws(" ", F.col("record"), F.lit("segment"), i.cast("string")))), *common, ("WARC-Segment-Origin-ID", _urn(F.col("record"))), number]
        return F.when(i == 0, first).otherwise(_record("continuation", [*after, ("WARC-Segment-Total-Length", F.when(i == F.size(parts) - 1, last))], x))

    records = F.when(F.col("refers_to").isNotNull(), F.array(revisit)).when(F.contains(full, F.lit(MARK)), F.transform(parts, segment)).otherwise(F.array(whole))

    def write(rows: DataFrame, mode: str) -> None:
        rows.select(F.explode(records).alias("value")).write.mode(mode).option("lineSep", END).option("compression", compression).text(path)

    plain = _urn(name(F.col("refers_to")))
    asked = plan.where("refers_to is not null").select(F.col("refers_to").alias("of_id"), F.col("from_digest").alias("of_digest")).distinct()
    repeated = plan.where("refers_to is null and times > 1").join(asked, (F.col("from_id") == F.col("of_id")) & (F.col("from_digest") == F.col("of_digest")), "left_semi")
    if not repeated.take(1):
        write(known.withColumn("origin", plain), "overwrite")
        return
    write(known.where("refers_to is null").withColumn("origin", plain), "overwrite")
    ids = _parsed(spark, path).where("record_type = 'response'").select("page_id", "payload_digest", "record")
    ids = ids.join(repeated.select("from_id", "from_digest"), (F.col("page_id") == F.col("from_id")) & (F.col("payload_digest") == F.col("from_digest")), "left_semi")
    # read before the archive is appended to
    ids = shared.written(ids.groupBy(F.col("page_id").alias("of_id"), F.col("payload_digest").alias("of_digest")).agg(F.min("record").alias("held")), f"{path.rstrip('/')}-ids")
    later = known.where("refers_to is not null").join(ids, (F.col("refers_to") == F.col("of_id")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    write(later.withColumn("origin", F.coalesce("held", plain)), "append")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of an archive: its headers, the id of the record or of a segment's first one, and its block."""
    found = spark.read.option("lineSep", MARK).text(path).where("value <> ''")
    head = F.expr(f"substring(value, 1, instr(value, '{END}') - 1)")
    lines = found.select(F.concat(F.lit("\r\nWARC-Type: "), head, F.lit("\r\n")).alias("head"), F.expr(f"encode(substring(value, instr(value, '{END}') + 4), 'UTF-8')").alias("body"))
    field = lambda name: F.nullif(F.regexp_extract("head", f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    return lines.select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"),
        field("WARC-Segment-Number").cast("int").alias("segment"),
        F.expr("substring(body, 1, cast(regexp_extract(head, '\r\nContent-Length: ([0-9]+)\r\n', 1) as int))").alias("block"),
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) per record under path.

    payload is what the record itself holds (null for a revisit), and digest and bytes are taken
    from it; a revisit's are its headers'. A record's segments are joined by its id.
    """
    parsed = _parsed(spark, path)
    columns = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    whole = parsed.where("segment is null").select(*columns, F.decode("block", "UTF-8").alias("block"))
    # segments are few, and those of one record only are together
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("segment", "block"))), lambda p: F.decode(p["block"], "UTF-8"))
    joined = parsed.where("segment is not null").groupBy("record").agg(*[F.max_by(c, -F.col("segment")).alias(c) for c in columns], F.array_join(blocks, "").alias("block"))
    every = whole.unionByName(joined.select(*columns, "block"))
    payload = F.when(F.col("record_type") == "response", F.expr(f"substring(block, instr(block, '{END}') + 4)"))
    every = every.withColumn("payload", payload).drop("block")
    return every.withColumn("payload_digest", F.coalesce(F.sha1(F.encode("payload", "UTF-8")), F.col("payload_digest"))).withColumn("payload_bytes", F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")))


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages to archives in a new folder of the shared workspace and returns what reading them finds."""
    path = f"{shared.workspace(pages.sparkSession)}/archives"
    write_archives(pages, path, least=least)
    return read_archives(pages.sparkSession, path)
