"""WARC archives: revisits resolved by payload digest, deduplicated archives written with fresh headers and read back.

Archives are gzipped WARC/1.1 files that Spark's text writer commits, so lost tasks leave nothing behind and any
file system that Spark knows will do. Only headers (id, digest, length) are shuffled by digest; payloads move by id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.functions.numbers import let
from newsgauge.llm.shared import staged

#: The alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Records of a file at most: a file is read back as one value.
RECORDS_PER_FILE = 5_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = ("page_id long, url string, record_type string, payload_digest string, refers_to long, "
               "payload_bytes long, payload string")


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1 of a binary column, which is hashed once: the digits of base 32 are made in
    four parts and only then exchanged for the letters."""
    def letters(digest: Column) -> Column:
        parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * part, 10), 16, 32), 8, "0") for part in range(4)]
        return F.translate(F.concat(*parts), DIGITS, BASE32)

    return let(F.sha1(data), letters)


def _records(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    return (pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"),
                         payload.alias("payload"))
            .withColumn("bytes", F.octet_length("payload").cast("bigint"))
            .withColumn("digest", sha1_base32(F.col("payload").cast("binary"))))


def _warc_text(revisit: Column, date: str) -> Column:
    """The text of one record; the writer's line separator adds the last line end."""
    end, nothing = "\r\n", F.lit("")
    one_line = F.regexp_replace(F.coalesce(F.col("url"), nothing), "[\\x00-\\x1F]", "")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(end + end))
    block = F.concat(http, F.when(revisit, nothing).otherwise(F.col("payload")))
    sign = F.md5(F.concat_ws("|", F.lit("record"), "page_id", "url", "digest").cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(sign, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{end}WARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">{end}WARC-Date: {date}"),
        F.when(one_line != "", F.concat(F.lit(f"{end}WARC-Target-URI: "), one_line)).otherwise(nothing),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.coalesce(F.concat(F.lit(f"{end}X-Page-Id: "), F.col("page_id").cast("string")), nothing),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: {REVISIT_PROFILE}{end}X-Refers-To-Page: "),
                                 F.col("original").cast("string"))).otherwise(nothing),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(end + end))
    return F.concat(head, block, F.lit(end))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` (page_id, url, html). Of payloads of at least ``min_bytes`` that are equal, the
    one with the smallest page_id is a response and the others revisits of it; smaller ones are all responses.

    A null html is an empty payload. Rows without an id are responses and nobody's original. Repeated rows with the
    original's id and payload are responses too.
    """
    records = _records(pages)
    heads = staged(records.filter((F.col("bytes") >= min_bytes) & F.col("page_id").isNotNull())
                   .select("page_id", "digest", "bytes"), "heads")
    originals = heads.groupBy("digest", "bytes").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
    revisits = (heads.join(originals.filter("copies > 1"), ["digest", "bytes"]).filter("page_id <> original")
                .select("page_id", "digest", "original").distinct())
    resolved = records.join(revisits, ["page_id", "digest"], "left")
    (resolved.select(_warc_text(F.col("original").isNotNull(), date).alias("value"))
     .write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive by their stated lengths; payloads may hold anything, also record headers."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        if data[at:at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {first[:40]!r}")
        named = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        block = data[stop + 4:stop + 4 + int(named["content-length"])]
        at = stop + 4 + len(block)
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        response = named["warc-type"] == "response"
        page, original = named.get("x-page-id"), named.get("x-refers-to-page")
        yield {
            "page_id": int(page) if page else None, "url": named.get("warc-target-uri"), "record_type": named["warc-type"],
            "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if response
            else named["warc-payload-digest"].removeprefix("sha1:"),
            "refers_to": int(original) if original else None,
            "payload_bytes": len(payload) if response else stated,
            "payload": payload.decode() if response else None,
        }


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of READ_SCHEMA; a response's digest and length are taken from its payload, a revisit's payload is null."""
    fields = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(fields, kinds, strict=True)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse_archive(content.as_py()):
                    rows.append(row)
                    held += row["payload_bytes"]
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(parse, READ_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Headers with each revisit joined to the response it names by digest; lengths come from the response read. The
    headers are stored, so that archives are read once."""
    heads = staged(records.select("page_id", "record_type", "payload_digest", "refers_to", "payload_bytes"), "read-heads")
    responses = (heads.filter("record_type = 'response'").groupBy("payload_digest")
                 .agg(F.min("page_id").alias("found"), F.max("payload_bytes").alias("found_bytes")))
    revisits = heads.filter("record_type = 'revisit'").join(responses, "payload_digest", "left")
    return heads.filter("record_type = 'response'").unionByName(revisits.select(
        "page_id", "record_type", "payload_digest", F.col("found").alias("refers_to"),
        F.coalesce("found_bytes", "payload_bytes").alias("payload_bytes")))
