"""WARC archives without repeated payloads.

Headers are shuffled by payload digest; of records with equal payloads of at
least ``min_bytes`` bytes that with the largest page_id is written as a
response and the others as revisit records that refer to it. Payloads meet
their originals by a broadcast of the repeated digests where these take at most
``BROADCAST_BYTES``, else by a shuffle on page_id and digest, so that a payload
which a third of all pages hold is no hot key. Archives are written by Spark's
text writer as gzip files of about ``file_bytes`` payload, in the shared folder,
and read back record by record.

Defined results
    null html: an empty payload; null url: no target header; null page_id:
    never an original, but a revisit like others, read back as null; repeated
    rows: each written under the same record id, those with the original's
    page_id as responses; ties: none, equal page_ids are one original; very
    long payloads: written and read whole; empty table: no archive, no rows;
    further columns: left out. Line breaks and blanks in urls are
    percent-encoded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed

NL = "\r\n"
#: Repeated digests of at most this size are broadcast.
BROADCAST_BYTES = 64_000_000
SCHEMA = "page_id long, record_type string, refers_to long, header_digest string, payload_bytes long, payload_digest string"


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Each page with payload, size, digest and the page_id and url of the response that it repeats, if any."""
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    body = body.select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("size"),
        F.sha1(F.col("payload").cast("binary")).alias("digest"),
    )
    heads = body.select("page_id", "url", "size", "digest").filter(F.col("size") >= min_bytes)
    first = heads.groupBy("digest", "size").agg(
        F.max(F.struct("page_id", "url")).alias("original"), F.count("*").alias("n")
    )
    first = checkpointed(first.filter("n > 1 and original.page_id is not null").select(
        "digest", "size", F.col("original.page_id").alias("to_id"), F.col("original.url").alias("to_url")
    ))
    took = first.agg(F.sum(F.lit(120) + F.coalesce(F.octet_length("to_url"), F.lit(0)))).first()[0] or 0
    if took <= BROADCAST_BYTES:
        out = body.join(F.broadcast(first), ["digest", "size"], "left")
    else:
        seen = heads.join(first, ["digest", "size"]).select(
            F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "to_id", "to_url"
        ).distinct()
        out = body.join(seen, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    repeated = F.col("to_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to_id"))
    return out.select(
        "page_id", "url", "payload", "size", "digest",
        F.when(repeated, F.col("to_id")).alias("to_id"), F.when(repeated, F.col("to_url")).alias("to_url"),
    )


def _uri(url: Column) -> Column:
    for raw, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        url = F.replace(url, F.lit(raw), F.lit(code))
    return url


def record_text(date: str) -> Column:
    """A record without the two line breaks that end it."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(NL)), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    nameless = F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">"))
    revisit = F.col("to_id").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + NL + "Content-Type: text/html; charset=utf-8" + NL + "Content-Length: "),
        F.col("size").cast("string"), F.lit(NL + NL),
    )
    return F.concat(
        F.lit("WARC/1.1" + NL),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn("page_id"), nameless)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", urn("to_id")),
                line("WARC-Refers-To-Target-URI", _uri(F.col("to_url"))),
                line("WARC-Refers-To-Date", F.lit(date)),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit(NL), http, F.when(revisit, "").otherwise(F.col("payload")),
    )


def write_archives(
    records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256_000_000
) -> None:
    """Write planned records as gzip-compressed WARC files under path, of so many records as hold about file_bytes on average."""
    sizes = records.agg(F.avg(F.col("size") + 600)).first()[0] or 600
    records_per_file = max(1, int(file_bytes / sizes))
    (
        records.select(record_text(date).alias("value"))
        .write.option("lineSep", NL + NL).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).mode("overwrite").text(path)
    )


def _records(blob: bytes) -> Iterator[tuple[dict[bytes, bytes], memoryview]]:
    """Headers and block of each record of an archive, decompressed piece by piece."""
    unzip, held, at = zlib.decompressobj(31), bytearray(), 0
    source = memoryview(blob)

    def more() -> bool:
        nonlocal at, unzip
        if at >= len(source):
            return False
        piece = bytes(source[at : at + 16384])
        at += len(piece)
        held.extend(unzip.decompress(piece))
        if unzip.eof:
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)
        return True

    begin = 0
    while True:
        while (cut := held.find(b"\r\n\r\n", begin)) < 0:
            if not more():
                return
        lines = bytes(held[begin:cut]).split(b"\r\n")
        head = dict(x.split(b": ", 1) for x in lines[1:])
        start = cut + 4
        end = start + int(head[b"Content-Length"])
        while len(held) < end + 4:
            if not more():
                break
        with memoryview(held) as view, view[start:end] as block:
            yield head, block
        begin = end + 4
        if begin > 1 << 23:
            del held[:begin]
            begin = 0


def _id(head: dict[bytes, bytes], name: bytes) -> int | None:
    value = head.get(name, b"")
    return int(value[10:-1]) if value.startswith(b"<urn:page:") else None


def _read(batches):
    for batch in batches:
        for blob in batch.column(0):
            rows = []
            for head, block in _records(blob.as_buffer()):
                kind, size, sha = head[b"WARC-Type"].decode(), None, None
                if kind == "response":
                    cut = bytes(block[:4096]).find(b"\r\n\r\n") + 4
                    with block[cut:] as payload:
                        size, sha = len(payload), hashlib.sha1(payload).hexdigest()
                named = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                rows.append((_id(head, b"WARC-Record-ID"), kind, _id(head, b"WARC-Refers-To"), named, size, sha))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, as it stands; size and digest of a response's payload are taken anew."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take size and digest from their response."""
    done = records.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    seen = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest"), "payload_bytes"
    ).dropDuplicates()
    again = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "header_digest")
    again = again.join(seen, ["refers_to", "header_digest"], "left").select(
        "page_id", "payload_bytes", F.col("header_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return done.unionByName(again)
