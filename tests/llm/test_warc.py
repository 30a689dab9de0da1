import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from halyard.llm import warc
from halyard.llm.common import fresh_path

LONG = "<html>" + "é text " * 300 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</html>"
ROWS = [
    (1, "http://a/1", LONG), (5, "http://a/5 x\r\nEvil: 1", LONG), (3, None, LONG), (2, "http://b", "short"), (4, "http://c", "short"), (6, "u", None), (7, "u", ""),
    (8, "u", "x" * 1000), (9, "u", "x" * 1000), (10, "u", "x" * 999), (11, "u", "x" * 999), (5, "again", LONG), (None, "n", LONG), (None, "m", LONG), (None, "k", "z" * 1500), (None, "l", "z" * 1500), (None, "s", "short"), (12, "u", "y" * 3_000_000),
]


def wanted():
    out = []
    for i, _, html in ROWS:
        body = (html or "").encode()
        last = max((j for j, _, h in ROWS if (h or "") == (html or "") and j is not None), default=None)
        again = len(body) >= 1000 and last is not None and i != last  # a page without an id is one of the others, too
        out.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_BYTES, 0])
def test_written_and_read_back(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    pages = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "page_id long, url string, html string, size int, digest string")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(warc.plan_records(pages), path, file_bytes=500_000)
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.resolve(warc.read_archives(spark, path)).collect()]
    assert sorted(got, key=str) == wanted()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    whole = b"".join(gzip.decompress(bytes(f["content"])) for f in files)
    assert whole.count(b"y" * 3_000_000) == 1 and whole.count(LONG.encode()) == 2  # the original and its repeated row
    assert whole.count(b"z" * 1500) == 2  # without ids there is no original
    assert b"\r\nEvil: 1" not in whole and b"WARC-Refers-To: <urn:page:5>" in whole


def test_members_one_after_another():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    blob = gzip.compress(record) + gzip.compress(record * 2)
    assert [bytes(b) for _, b in warc._records(blob)] == [b"abc"] * 3
    assert zlib.decompress(gzip.compress(record), 31) == record


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-empty")
    warc.write_archives(warc.plan_records(pages), path)
    assert warc.resolve(warc.read_archives(spark, path)).filter(F.lit(True)).count() == 0
