"""WARC round trip, framing and digests."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import types as T

from shopsignals.llm.warc import WarcError, page_records, read_archives, read_records, record, write_pages

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("refers_to", T.StringType())])


def brute(rows):
    out = []
    for pid, _, html, *_ in rows:
        b = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == b and p is not None]
        first = min(same) if len(b) >= 100 and same else None
        again = first is not None and pid != first
        out.append((pid, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long = "<p>é\U0001F600\r\n\r\n" * 30000
    html = ["a" * 99, "a" * 100, "é" * 50, long, "", None, "HTTP/1.1 200 OK\r\n\r\nx" * 8]
    rows = [(i, "http://x/\r\ny" if i % 5 == 0 else "http://h/é", html[i % len(html)], "d", "r") for i in range(60, 0, -1)]
    rows += [(1000 + i, None, f"page {i} " * 40, None, None) for i in range(40)] + [(7, "", "a" * 100, "", ""), (None, "", "a" * 100, "", ""),
                                                                                  (None, "", "n" * 100, "", ""), (None, "", "n" * 100, "", "")]
    m = write_pages(spark.createDataFrame(rows, SCHEMA).repartition(5), roll=4000)
    assert m.count() > 5
    got = page_records(m).collect()
    assert all(r["verified"] for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    back = read_archives(m, keep_payload=True).where("record_type = 'response'").collect()
    want = {(r[2] or "").encode() for r in rows}
    assert {bytes(r["payload"]) for r in back} == want
    path = m.first()["path"].removeprefix("file://")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")  # members together are one gzip file


def test_empty_table(spark):
    assert page_records(write_pages(spark.createDataFrame([], SCHEMA))).collect() == []


def test_broken_archives():
    sha = lambda b: hashlib.sha256(b).hexdigest()
    good = [record("response", f"urn:page:{i}", "u", b"x" * (i * 70000), sha(b"x" * (i * 70000)), None, "d") for i in range(3)]
    rows = list(read_records(io.BytesIO(b"".join(good))))
    assert [r["payload_bytes"] for r in rows] == [0, 70000, 140000] and all(r["verified"] for r in rows)
    assert [r["offset"] for r in rows] == [0, len(good[0]), len(good[0]) + len(good[1])]
    assert list(read_records(io.BytesIO(b""))) == []
    wrong = record("response", "urn:page:1", "u", b"payload", sha(b"other"), None, "d")
    assert [r["verified"] for r in read_records(io.BytesIO(wrong))] == [False]
    plain = gzip.decompress(good[1])
    for bad in (good[1][:-20], b"junk" + good[0], gzip.compress(plain[:-10]), gzip.compress(plain + b"more"),
                gzip.compress(plain.replace(b"Content-Length", b"Content-Size")), gzip.compress(b"no record")):
        with pytest.raises(WarcError):
            list(read_records(io.BytesIO(bad)))
