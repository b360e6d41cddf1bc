r"""A content-addressed WARC archive.

An archive is two tables. ``payloads`` has the bytes of every distinct payload
once, under their SHA-256. ``records`` has the exact header block of every WARC
record (version line, named fields, HTTP head) and no payload; the digest in the
header says which payload belongs to it. Of records with equal payloads of at
least ``LEAST`` bytes one is a ``response`` and the others ``revisit`` it.

* A digest is verified when it is written, by the length and a second,
  independent hash of all payloads that have it, and when it is read, by digesting
  the stored bytes anew. Either ends the job if it does not hold.
* The response of a digest is chosen with partial aggregates, so a payload that
  a third of all pages share is one row per task there; joins of records with the
  digests that several records have are split by adaptive execution.
* Payloads are shuffled once per digest and task; headers never carry them.

Defined results: null html is an empty payload; a null url leaves its field out,
one with control characters is written in base64; the response is the record of
the smallest page_id, null last, and of several rows with that id the first in the
order of the archive; repeated rows are records of their own; an empty table gives
an empty archive; texts of any length are one payload, up to Spark's limit of a
value; only page_id, url and html are read, other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm.store import settled, stored

LEAST = 100
RESPONSE, REVISIT = "response", "revisit"
CRLF = "\r\n"
# Names that the WARC standard gives.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Date of capture where the pages name none; a constant, so that reruns agree.
CAPTURED = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """``records`` (page_id, header) and ``payloads`` (digest, payload)."""

    records: DataFrame
    payloads: DataFrame


def record_name(row: Column) -> Column:
    """A record id that follows from the place of the record in the archive; null for none."""
    digest = F.sha2(F.concat(F.lit("record:"), row.cast("string")).cast("binary"), 256)
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(row.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def http_head(n_bytes: Column) -> Column:
    return F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        n_bytes.cast("string"), F.lit(CRLF + CRLF),
    )


def header() -> Column:
    """The header block of a record, from its columns ``row``, ``url``, ``digest``, ``n_bytes`` and ``first``."""
    again = F.col("first").isNotNull()
    http = http_head(F.col("n_bytes"))
    length = F.char_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n_bytes"))
    odd = F.col("url").rlike(r"[\x00-\x1F\x7F]")
    return F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(again, REVISIT).otherwise(RESPONSE)),
        _line("WARC-Record-ID", record_name(F.col("row"))),
        _line("WARC-Date", F.lit(CAPTURED)),
        _line("WARC-Target-URI", F.when(~odd, F.col("url"))),
        _line("Target-URI-Base64", F.when(odd, F.replace(F.base64(F.col("url").cast("binary")), F.lit(CRLF), F.lit("")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", record_name(F.col("first"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(CRLF), http,
    )


def write(pages: DataFrame, least: int = LEAST) -> Archive:
    """The archive of ``pages``, stored in the shared folder."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    given = pages.select("page_id", "url", payload.alias("payload"))
    digest = F.sha2("payload", 256).alias("digest")
    rows = stored(given.select(
        "page_id", "url", digest, F.octet_length("payload").cast("long").alias("n_bytes"),
        F.xxhash64("payload").alias("check"), F.monotonically_increasing_id().alias("row"),
    ))
    unlike = (F.min("n_bytes") != F.max("n_bytes")) | (F.min("check") != F.max("check"))
    low = F.min(F.struct(F.col("page_id").isNull(), "page_id", "row")).getField("row")
    shared = (
        rows.groupBy("digest")
        .agg(low.alias("first"), F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("most"), unlike.alias("unlike"))
        .select(
            "digest", "n", "most",
            F.when(F.col("unlike"), F.raise_error(F.concat(F.lit("different payloads under one digest: "), "digest")).cast("long"))
            .otherwise(F.col("first")).alias("first"),
        )
        .filter((F.col("n") > 1) & (F.col("most") >= least)).select("digest", "first")
    )
    typed = rows.join(shared, "digest", "left").withColumn(
        "first", F.when(F.col("first") != F.col("row"), F.col("first"))
    )
    records = stored(typed.select("page_id", header().alias("header")))
    payloads = stored(given.select(digest, "payload").groupBy("digest").agg(F.any_value("payload").alias("payload")))
    return Archive(records, payloads)


def field(name: str, block: Column | None = None) -> Column:
    """A named field of a header block; null where it is missing."""
    found = F.regexp_extract(F.col("header") if block is None else block, rf"(?md)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def parsed(records: DataFrame) -> DataFrame:
    """page_id, record_id, record_type, url, digest, refers (record id) and header of every record, read from its header."""
    coded = F.unbase64(field("Target-URI-Base64")).cast("string")
    return records.select(
        "page_id", field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"),
        F.coalesce(field("WARC-Target-URI"), coded).alias("url"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        field("WARC-Refers-To").alias("refers"), "header",
    )


def verified(payloads: DataFrame) -> DataFrame:
    """(digest, payload, payload_bytes) of the stored payloads, digested anew; others than their digest says end the job."""
    anew = F.sha2("payload", 256)
    wrong = F.raise_error(F.concat(F.lit("payload does not have its digest: "), F.col("digest")))
    return payloads.select(
        F.when(anew == F.col("digest"), anew).otherwise(wrong.cast("string")).alias("digest"), "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


def listed(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id) of every record.

    Lengths and digests are those of the stored bytes; a payload that is not there ends the job.
    """
    known = parsed(archive.records).drop("header", "url")
    sizes = verified(archive.payloads).select("digest", "payload_bytes")
    original = known.filter(F.col("record_type") == RESPONSE).select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")
    )
    again = known.filter(F.col("refers").isNotNull()).select("refers").distinct()
    named = known.join(original.join(again, "refers", "left_semi"), "refers", "left")
    lost = F.raise_error(F.concat(F.lit("payload missing: "), F.col("digest"))).cast("long")
    return named.join(sizes, "digest", "left").select(
        "page_id", F.when(F.col("payload_bytes").isNull(), lost).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to",
    )


def records(archive: Archive) -> DataFrame:
    """page_id, record_id, record_type, url, payload and record (all bytes as a WARC file holds them) of every record.

    A revisit has the payload of the record it refers to; its own bytes end with the HTTP head.
    """
    whole = parsed(archive.records).join(verified(archive.payloads), "digest")
    body = F.when(F.col("record_type") == RESPONSE, F.col("payload")).otherwise(F.lit(b""))
    return whole.select(
        "page_id", "record_id", "record_type", "url", "payload",
        F.concat(F.col("header").cast("binary"), body, F.lit((CRLF + CRLF).encode())).alias("record"),
    )


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` written to an archive and listed from it; the archive itself is removed."""
    return settled(pages.sparkSession, lambda: listed(write(pages, least)))
