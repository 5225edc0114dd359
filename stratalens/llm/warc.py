"""Content-addressed WARC archive.

Every payload is stored once, under its SHA-256; exact record headers are kept
apart.  Reading joins both, after each stored payload was hashed again and
compared with the digest it is stored under, and rebuilds the records' bytes.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the
smallest ``page_id`` is the response and the others revisit it; smaller payloads
are always responses.  A null ``html`` is an empty payload.  A null ``page_id``
keeps its row, is a response and is never referred to.  Rows that share the
smallest id are all responses.  Line breaks in a url are percent-encoded; a null
url is left out of the header.  Extra columns are ignored; nothing is sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.runtime import materialize, release

REVISIT_BYTES = 100
URN = "urn:page:"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """``headers(page_id, digest, header, http_header)`` and
    ``payloads(digest, payload)``."""

    headers: DataFrame
    payloads: DataFrame


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def _lines(*lines: Column) -> Column:
    """Header lines, nulls left out, each ended by CRLF."""
    return F.concat(*[F.coalesce(F.concat(x, F.lit(CRLF)), F.lit("")) for x in lines])


def write(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Archive ``pages(page_id, url, html)``; both tables are written out, and what
    led to them is dropped, so payloads never lie in two shuffles at once."""
    rows = pages.select("page_id", "url", _payload().alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = materialize(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size")), "ids", drop=True)
    first = materialize(ids.groupBy("digest").agg(F.min("page_id").alias("first_id")), "first", drop=True)
    revisit = (F.col("size") >= REVISIT_BYTES) & (F.col("page_id") > F.col("first_id"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.when(~F.coalesce("revisit", F.lit(False)), _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), F.lit("")))
    header = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn("first_id"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size") + F.octet_length("http_header")).cast("string")),
        F.lit(""),
    )
    headers = ids.join(first, "digest").withColumn("revisit", revisit).withColumn("http_header", http).select("page_id", "digest", header.alias("header"), "http_header")
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    archive = Archive(materialize(headers, "headers", drop=True), materialize(payloads, "payloads", drop=True))
    release(ids, first)
    return archive


def verified(archive: Archive) -> DataFrame:
    """``payloads`` after a check: a payload that does not match the digest it is
    stored under raises an error."""
    right = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
    wrong = F.raise_error(F.concat(F.lit("payload does not match "), F.col("digest"))).cast("binary")
    return archive.payloads.select("digest", F.coalesce(right, wrong).alias("payload"))


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def records(archive: Archive) -> DataFrame:
    """``(record, stored)``: each record's exact bytes, rebuilt by a join, and the
    payload that its digest stands for, which a revisit does not hold itself."""
    body = F.when(F.col("http_header").isNotNull(), F.concat(F.encode("http_header", "UTF-8"), F.col("payload"))).otherwise(F.lit(b""))
    joined = archive.headers.join(verified(archive), "digest")
    return joined.select(F.concat(F.encode("header", "UTF-8"), body, F.lit((CRLF * 2).encode())).alias("record"), F.col("payload").alias("stored"))


def read(archive: Archive) -> DataFrame:
    """One row a record, every value parsed from the record's bytes: ``page_id``,
    ``url``, ``record_type``, ``refers_to``, ``payload_digest``, ``payload_bytes``,
    ``payload`` (revisits resolved) and ``record``.  A payload that does not match
    the record's digest raises an error."""
    number = lambda name: F.regexp_extract(F.coalesce(_field(name), F.lit("")), rf"<{URN}(-?[0-9]+)>", 1)
    whole = lambda name: F.when(number(name) != "", number(name)).cast("long")
    end = F.lit(CRLF * 2)
    told = records(archive).withColumn("head", F.concat(F.substring_index(F.col("record").cast("string"), CRLF * 2, 1), F.lit(CRLF)))
    told = told.withColumn("body", F.substring("record", F.octet_length("head") + 3, _field("Content-Length").cast("int")))
    # the HTTP header is ASCII, so its end has one place in characters and bytes
    own = F.substring(F.col("body"), F.locate(CRLF * 2, F.col("body").cast("string")) + F.length(end), F.octet_length("body"))
    told = told.withColumn("payload", F.when(_field("WARC-Type") == "response", own).otherwise(F.col("stored")))
    digest, named = F.sha2("payload", 256), _field("WARC-Payload-Digest")
    checked = F.when(F.concat(F.lit("sha256:"), digest) == named, digest).otherwise(F.raise_error(F.concat(F.lit("payload does not match "), named)).cast("string"))
    return told.select(
        whole("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        whole("WARC-Refers-To").alias("refers_to"),
        checked.alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "payload",
        "record",
    )


def op6(pages: DataFrame) -> DataFrame:
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
select page_id, size as payload_bytes, digest as payload_digest,
  case when size >= {REVISIT_BYTES} and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when size >= {REVISIT_BYTES} and page_id > first_id then first_id end as refers_to
from (select *, min(page_id) over (partition by digest) as first_id from (
  select page_id, sha256(coalesce(html, '')) as digest, cast(octet_length(encode(coalesce(html, ''))) as bigint) as size from pages) a) b"""
