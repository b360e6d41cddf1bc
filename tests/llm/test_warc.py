"""The archive against a plain version, read back byte by byte; damaged archives."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slotcast.llm import store, warc

HTML = "<p>" + "x" * 200 + "é𝄞</p>"
SCHEMA = "page_id long, url string, html string, digest string, row int, first long, header string, payload string, n_bytes int"


def pages():
    given = [
        (5, "http://a.com/", HTML), (3, "http://b.com/?q=1", HTML), (3, "http://b.com/?q=1", HTML), (None, "http://c.com", HTML),
        (9, "http://d.com/\r\nWARC-Type: fake x", HTML + " "), (10, None, "short"), (11, "http://e.com", "short"),
        (12, "http://f.com", None), (13, "http://g.com", ""), (None, None, None), (14, "http://h.com", "y" * 100),
        (15, "http://i.com", "y" * 100), (16, "http://j.com", "y" * 99), (17, "http://k.com", "y" * 99),
        (None, "http://l.com", "z" * 500), (None, "http://m.com", "z" * 500), (20, "http://n.com", "long " * 300_000),
        (19, "http://o.com", "long " * 300_000),
    ]
    return given + [(100 + i, f"http://p.com/{i}", "hot " * 100) for i in range(60)]


def frame(spark, rows=None):
    return spark.createDataFrame([(*r, "d", 1, 2, "h", "p", 3) for r in (pages() if rows is None else rows)], SCHEMA).repartition(5)


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    found, seen = [], {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, _, html in order:
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in seen
        found.append((i, len(data), digest, "revisit" if again else "response", seen[digest] if again else None))
        seen.setdefault(digest, i)
    return Counter(found)


def test_listing(spark):
    assert Counter(map(tuple, warc.round_trip(frame(spark)).collect())) == plain(pages())
    assert warc.round_trip(frame(spark, [])).collect() == []


def split(record):
    """Named fields and content of a WARC record, by the lengths it gives."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    assert version == b"WARC/1.1"
    fields = dict(line.decode().split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    assert rest[length:] == b"\r\n\r\n"
    http, _, body = rest[:length].partition(b"\r\n\r\n")
    return fields, http, body


def test_records_are_whole(spark):
    with store.owned(spark):
        archive = warc.write(frame(spark))
        kept = archive.payloads.select("digest", F.sha2("payload", 256).alias("anew")).collect()
        rows = warc.records(archive).collect()
    digests = {hashlib.sha256((h or "").encode()).hexdigest() for *_, h in pages()}
    assert len(kept) == len(digests) and {r[0] for r in kept} == digests and all(r[0] == r[1] for r in kept)
    assert Counter((r["page_id"], r["url"], bytes(r["payload"])) for r in rows) == Counter(
        (i, u, (h or "").encode()) for i, u, h in pages())
    names = {r["record_id"]: r for r in rows}
    assert len(names) == len(pages())
    for r in rows:
        fields, http, body = split(bytes(r["record"]))
        assert fields["WARC-Type"] == r["record_type"] and fields["WARC-Record-ID"] == r["record_id"]
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(r["payload"]).hexdigest()
        assert f"Content-Length: {len(r['payload'])}".encode() in http
        if r["record_type"] == "response":
            assert body == bytes(r["payload"]) and "WARC-Refers-To" not in fields
        else:
            source = names[fields["WARC-Refers-To"]]
            assert body == b"" and source["record_type"] == "response" and source["payload"] == r["payload"]


def test_damage_ends_the_job(spark):
    with store.owned(spark):
        archive = warc.write(frame(spark))
        other = F.when(F.octet_length("payload") == 99, F.lit(b"other")).otherwise(F.col("payload"))
        with pytest.raises(Exception, match="does not have its digest"):
            warc.listed(warc.Archive(archive.records, archive.payloads.withColumn("payload", other))).collect()
        with pytest.raises(Exception, match="payload missing"):
            warc.listed(warc.Archive(archive.records, archive.payloads.limit(3))).collect()


def test_no_table_outlives_its_owner(spark):
    from tests.llm.test_store import tables

    before = tables(spark)
    with store.owned(spark):
        assert warc.round_trip(frame(spark)).count() == len(pages())
    assert tables(spark) == before
