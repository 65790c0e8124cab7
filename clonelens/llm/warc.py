"""Content-addressed WARC archive.

``write_archive`` stores two tables: ``payloads`` (each distinct payload once, under its SHA-256) and ``records``
(the exact bytes of every page's WARC header and, for a response, of the HTTP header before its payload, with the
payload's address). ``read_archive`` reconstructs the original records by joining the two, checks every payload
against its address again, and parses the headers back; ``verified_records`` gives every record, revisits included,
the size and digest of the payload that its address leads to.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is a response and
the others are revisit records that refer to it; smaller payloads are all responses. Headers, digests and checks are
built-in SQL functions; payloads are compressed in Arrow batches before they move. Only small columns are shuffled for
the grouping; of payloads, each task keeps one row per address before the one shuffle that stores them.

Defined cases: a null html is an empty payload; a null url is an empty target; CR and LF in a url are written as
%0D and %0A; rows that share the largest page_id of their payload are all responses (they have one record id), a null
page_id is smaller than all others; an empty table gives empty archives; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WRITE_OPTIONS, materialise, shared_dir

#: The RFC 4648 base-32 alphabet and WARC's profile for identical payloads.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    records: str
    payloads: str


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base-32 SHA-1 of a binary column: 160 bits are 32 digits of 5 bits."""
    digest, digits = F.sha1(data), []
    for block in range(4):
        number = F.conv(F.substring(digest, block * 10 + 1, 10), 16, 10).cast("bigint")
        for i in range(7, -1, -1):
            digits.append(F.substring(F.lit(BASE32), F.shiftright(number, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def http_header(size: Column) -> Column:
    """The HTTP header that stands before a response's payload."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))


def header(kind: str, page_id: Column, url: Column, date: Column, digest: Column, size: Column, refers_to: Column | None) -> Column:
    """Exact header block of one record up to the payload: up to and including the empty line, and for a response the
    HTTP header that its block begins with."""
    target = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page_id)),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.concat(F.lit("X-Payload-Length: "), size.cast("string")),
    ]
    if refers_to is not None:
        lines += [F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), record_id(refers_to)), F.lit("Content-Length: 0")]
        return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)).cast("binary")
    http = http_header(size)
    lines += [F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), (F.length(http) + size).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http).cast("binary")


def packed(df: DataFrame) -> DataFrame:
    """``address, payload`` with payloads as single zstd frames: shuffles and the store hold compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            small = pa.array([pack(x) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), small], names=["address", "payload"])

    return df.select("address", "payload").mapInArrow(run, "address string, payload binary")


def write_archive(pages: DataFrame, min_bytes: int = 0, date: str | None = None) -> Archive:
    """Write ``pages(page_id, url, html)`` and return where the two tables lie in the shared folder. ``date`` is the
    records' WARC-Date in UTC; the time of the call by default."""
    spark = pages.sparkSession
    written = F.lit(date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    small = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", F.length("payload").cast("bigint").alias("size"), F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("digest"),
    )
    small = materialise(small, "warc-index")
    newest = small.groupBy("address", "size").agg(F.max("page_id").alias("response_id"))
    told = small.join(newest, ["address", "size"]).withColumn("response", (F.col("size") < min_bytes) | F.col("page_id").eqNullSafe(F.col("response_id")))
    plain = header("response", F.col("page_id"), F.col("url"), written, F.col("digest"), F.col("size"), None)
    again = header("revisit", F.col("page_id"), F.col("url"), written, F.col("digest"), F.col("size"), F.col("response_id"))
    records = told.select("page_id", "address", "response", F.when(F.col("response"), plain).otherwise(again).alias("header"))
    base = f"{shared_dir(spark)}/clonelens/warc-{uuid.uuid4().hex}"
    records.write.options(**WRITE_OPTIONS).parquet(f"{base}/records")
    # equal addresses are equal bytes: each task keeps one row per address before the only shuffle of payloads
    once = pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("address"), "payload")
    once = packed(once).dropDuplicates(["address"])
    once.write.options(**WRITE_OPTIONS).parquet(f"{base}/payloads")
    return Archive(f"{base}/records", f"{base}/payloads")


def header_field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Original records: page_id, record_type, digest, size, refers_to, address, and ``record`` (the full bytes)
    for responses. Fails when a stored payload does not hash to its address or a record to its digest."""
    records = spark.read.schema("page_id bigint, address string, response boolean, header binary").parquet(archive.records)
    payloads = spark.read.schema("address string, payload binary").parquet(archive.payloads)
    parsed = records.select(
        F.nullif(F.regexp_extract(header_field("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1), F.lit("")).cast("bigint").alias("page_id"),
        header_field("WARC-Type").alias("record_type"),
        F.regexp_replace(header_field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        header_field("X-Payload-Length").cast("bigint").alias("size"),
        F.nullif(F.regexp_extract(header_field("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1), F.lit("")).cast("bigint").alias("refers_to"),
        "address",
        "header",
    )
    heads = parsed.where("record_type = 'response'")
    full = _inflated(heads.join(payloads, "address", "left"))
    good = F.coalesce(F.sha2("payload", 256) == F.col("address"), F.lit(False))
    problem = F.when(~good, F.raise_error(F.concat(F.lit("payload missing or damaged: "), "address")))
    full = full.withColumn("payload", F.coalesce(problem.cast("binary"), F.col("payload")))
    wrong = F.when(base32_sha1(F.col("payload")) != F.col("digest"), F.raise_error(F.concat(F.lit("digest differs: "), "address")))
    full = full.withColumn("record", F.coalesce(wrong.cast("binary"), F.concat("header", "payload", F.lit(CRLF * 2).cast("binary"))))
    names = ["page_id", "record_type", "digest", "size", "refers_to", "address", "record"]
    rest = parsed.where("record_type = 'revisit'").withColumn("record", F.concat("header", F.lit(CRLF * 2).cast("binary")))
    return full.select(*names, "payload").union(rest.select(*names, F.lit(None).cast("binary")))


def _inflated(df: DataFrame) -> DataFrame:
    """df with its compressed ``payload`` column unpacked; all other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at = batch.schema.get_field_index("payload")
            plain = pa.array([None if x is None else unpack(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([plain if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def restore_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id and full payload of every page, revisits included: records joined to payloads by address."""
    records = spark.read.schema("page_id bigint, address string, response boolean, header binary").parquet(archive.records)
    payloads = spark.read.schema("address string, payload binary").parquet(archive.payloads)
    return _inflated(records.select("page_id", "address").join(payloads, "address").select("page_id", "payload"))


def verified_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, and the size and digest of the rebuilt payload, of every record. Payloads are
    rebuilt and checked once, with their response; revisits join the result by their address, and one whose header
    states another size or digest, or whose payload is missing, fails the read."""
    back = read_archive(spark, archive)
    own = back.where("record_type = 'response'").select(
        "page_id", "address", F.length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    own = materialise(own, "warc-verified")
    once = own.groupBy("address").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    rest = back.where("record_type = 'revisit'").select("page_id", "address", "refers_to", "digest", "size").join(once, "address", "left")
    same = F.coalesce((F.col("digest") == F.col("payload_digest")) & (F.col("size") == F.col("payload_bytes")), F.lit(False))
    wrong = F.when(~same, F.raise_error(F.concat(F.lit("revisit of another payload: "), "address")))
    told = rest.select("page_id", F.lit("revisit").alias("record_type"), "refers_to", "payload_bytes", F.coalesce(wrong.cast("string"), F.col("payload_digest")).alias("payload_digest"))
    response = own.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"), "payload_bytes", "payload_digest")
    return response.union(told)


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archive, read it back, and return the digest columns of the WARC contract, computed from the rebuilt
    payloads."""
    back = verified_records(pages.sparkSession, write_archive(pages, min_bytes))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_sql() -> str:
    """The query's result in DuckDB SQL."""
    digits = "list_transform(range(0, 32), lambda i: '" + BASE32 + "'[1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)])"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, strlen(t) AS size, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS newest FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, array_to_string({digits}, '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM h"""
