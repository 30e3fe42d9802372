"""Content-addressed WARC archive [operator 2].

Method: an archive is two tables. Payloads holds each distinct payload once under its SHA-256 digest; records holds
the exact header bytes of each record and the digest of its payload. Original records come back by joining the two;
each digest is computed again from the stored bytes and compared with the header's.

Of records with equal payloads of at least FULL bytes the one with the smallest page id is a response, the others are
revisits that refer to it; smaller payloads are all responses. Null html is an empty payload; null url gives an
empty target. A null page id counts as larger than any other, and a revisit of such rows alone refers to null. Rows
that repeat the smallest id are all responses. An empty table gives empty archives. Other columns are not read.

Pages that were fetched at no known time are dated by UNDATED; archive() takes a column of dates. Records that share a page
id, or have none, share a record id. A record whose payload is lost or damaged raises an error when it is read.

Pages are digested once for headers and once for payloads. Only ids and digests meet in the choice of responses, counted
by digest first, so copies that are a large part of all pages combine before the shuffle; its join goes by digest and salt.
The payload joins are sort-merge joins of plain exchanges, which adaptive execution splits where a digest is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.llm.base import removed, table, written

FULL = 100
SALTS = 16
#: The lines of a record's header, in order.
CRLF = "\r\n"
#: Date of records without one.
UNDATED = "1970-01-01T00:00:00Z"


def header(kind: Column, page_id: Column, url: Column, digest: Column, refers: Column, size: Column, date: Column) -> Column:
    """Header text of a WARC/1.1 record. Line ends in a URL are escaped, so each field stays one line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    ident = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">"))
    target = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", ident(page_id)),
        line("WARC-Date", date),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", ident(refers)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
        F.lit(CRLF),
    )


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload: Column | None = None, date: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, payloads), written in the shared folder. payload: bytes, html in UTF-8 by default; date: text in UTC."""
    body = F.coalesce(F.encode("html", "utf-8") if payload is None else payload, F.lit(b""))
    dated = F.coalesce(F.lit(None).cast("string") if date is None else date, F.lit(UNDATED))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), dated.alias("date"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = written(rows.select("page_id", "url", "date", "digest", F.length("payload").cast("long").alias("size")), "warc-heads")
    firsts = heads.where(F.col("size") >= FULL).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", F.col("first"), F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    found = heads.withColumn("salt", salt).join(firsts.withColumn("copied", F.lit(True)), ["digest", "salt"], "left")
    kind = F.when(F.col("copied") & ~F.col("page_id").eqNullSafe(F.col("first")), "revisit").otherwise("response")
    text = header(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("first"), F.col("size"), F.col("date"))
    records = written(found.select("digest", F.encode(text, "utf-8").alias("head")), "warc-records")
    removed(heads)
    payloads = written(rows.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload")), "warc-payloads")
    return records, payloads


def checked(payloads: DataFrame) -> DataFrame:
    """(digest, payload, found): stored payloads with the digest of their bytes, which has to be the one they stand under."""
    found = F.sha2("payload", 256)
    fault = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))).cast("string")
    return payloads.select("digest", "payload", F.when(found == F.col("digest"), found).otherwise(fault).alias("found"))


def present(value_: Column) -> Column:
    """A value of a joined payload, which every record must have."""
    fault = F.raise_error(F.concat(F.lit("no payload is stored under the digest "), F.col("digest")))
    return F.when(F.col("found").isNotNull(), value_).otherwise(fault)


def rebuilt(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(record, head, payload): the bytes of each original record, its header's text and its full payload."""
    joined = records.join(checked(payloads), "digest", "left").withColumn("payload", present(F.col("payload")))
    head = F.decode("head", "utf-8")
    block = F.when(head.rlike(r"(?md)^WARC-Type: revisit\r$"), F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(F.concat("head", block, F.lit(b"\r\n\r\n")).alias("record"), head.alias("head"), "payload")


def value(name: str, of: str = r"([^\r]*)") -> Column:
    """A line of the header in the column head."""
    return F.regexp_extract("head", rf"(?md)^{name}: {of}\r$", 1)


def told(whole: DataFrame) -> DataFrame:
    """What each rebuilt record's header says, and the size and digest of its full payload.

    A record has to be its header, as many bytes as the header's Content-Length, and the two line ends.
    """
    page = lambda name: F.expr(f"try_cast({name} as bigint)")
    sound = F.length("record") == F.length(F.encode("head", "utf-8")) + value("Content-Length", "([0-9]+)").try_cast("bigint") + 4
    fault = F.raise_error(F.concat(F.lit("record differs from its Content-Length: "), F.col("head"))).cast("bigint")
    size = F.when(sound, F.length("payload").cast("long")).otherwise(fault)
    parsed = whole.select(value("WARC-Record-ID", "<urn:page:([^>]*)>").alias("own"), size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), value("WARC-Type").alias("record_type"), value("WARC-Refers-To", "<urn:page:([^>]*)>").alias("to"))
    return parsed.select(page("own").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("to").alias("refers_to"))


def listed(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """The rows of told() without rebuilding records.

    Stored payloads are read and digested once each, before the join, so only their sizes and digests are shuffled.
    """
    number = lambda name: F.expr(f"try_cast({name} as bigint)")
    facts = checked(payloads).select("digest", F.length("payload").cast("long").alias("payload_bytes"), F.col("found").alias("payload_digest"))
    heads = records.select(F.decode("head", "utf-8").alias("head")).withColumn("digest", value("WARC-Payload-Digest", "sha256:([0-9a-f]*)"))
    parsed = heads.select("digest", value("WARC-Record-ID", "<urn:page:([^>]*)>").alias("own"), value("WARC-Type").alias("record_type"), value("WARC-Refers-To", "<urn:page:([^>]*)>").alias("to"))
    joined = parsed.join(facts.withColumnRenamed("payload_digest", "found"), "digest", "left")
    return joined.select(number("own").alias("page_id"), present(F.col("payload_bytes")).alias("payload_bytes"), F.col("found").alias("payload_digest"), "record_type", number("to").alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(rebuilt(*archive(table(spark, sf_dir, "pages"))))


OP2_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha256(b) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
