"""A content-addressed WARC archive.

Two tables in a shared folder make an archive: ``payloads`` holds the bytes of each distinct payload once, under its
SHA-256; ``records`` holds the exact header bytes of every record and the digest of its payload. A record is
reconstructed by a join of the two, and the digest of the bytes is verified each time they are read.

Of records with equal payloads of at least ``least`` bytes, those with the largest page_id are responses and the
others revisits that refer to it; records with smaller payloads are all responses.

Defined results: a null html counts as empty; a null url is written as "about:blank", line ends and blanks in it are
percent-encoded; a null page_id is written as "-" and never referred to (if no record of a payload has an id, all are
responses); rows with the same page_id are each a record, and all rows that tie for the largest id are responses.
Payload sizes are not limited beyond what one row may hold. Empty tables give empty archives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh_path, small_batches

DATE = "2024-01-01T00:00:00Z"
_RECORDS = "page_id long, record_type string, refers_to long, digest string, header binary"
_PAYLOADS = "digest string, payload binary"
_CRLF = "\r\n"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five of them are four letters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = []
    for k in range(8):
        value = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(alphabet, F.shiftright(value, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def _headers(page: Column, url: Column, kind: Column, refers: Column, size: Column, sha1: Column) -> Column:
    """The bytes of a record before its payload: the WARC header, an empty line, and the HTTP response header."""
    name = lambda p: F.concat(F.lit("<urn:page:"), F.coalesce(p.cast("string"), F.lit("-")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), size.cast("string"), F.lit(_CRLF * 2))
    safe = F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\x00-\x20]", "%20")
    revisit = kind == "revisit"
    lines = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind,
        F.lit(f"{_CRLF}WARC-Record-ID: "), name(page),
        F.lit(f"{_CRLF}WARC-Date: {DATE}{_CRLF}WARC-Target-URI: "), safe,
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), sha1,
        F.when(revisit, F.concat(F.lit(f"{_CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}WARC-Refers-To: "), name(refers))).otherwise(""),
        F.lit(f"{_CRLF}Content-Type: application/http;msgtype=response{_CRLF}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string"),
        F.lit(_CRLF * 2), http,
    )
    return F.encode(lines, "UTF-8")


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write pages (page_id, url, html) as an archive at path."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    # one row a payload leaves each task, however many records share it
    rows.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), base32(F.sha1("payload")).alias("sha1"))
    largest = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"))
    joined = narrow.join(largest, "digest", "left")  # the hot payload's records are plain rows of a join: AQE splits them
    revisit = F.coalesce(F.col("page_id") != F.col("largest"), F.col("largest").isNotNull())
    typed = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    typed = typed.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("largest")))
    header = _headers(*map(F.col, ("page_id", "url", "record_type", "refers_to", "size", "sha1")))
    typed.select("page_id", "record_type", "refers_to", "digest", header.alias("header")).write.parquet(f"{path}/records")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record, reconstructed: page_id, digest and the exact bytes (a revisit's have no payload)."""
    headers = spark.read.schema(_RECORDS).parquet(f"{path}/records")
    payloads = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads")
    revisits = headers.where("record_type = 'revisit'")
    full = headers.where("record_type = 'response'").join(payloads, "digest")
    end = F.encode(F.lit(_CRLF * 2), "UTF-8")
    whole = full.select("page_id", "digest", F.concat("header", "payload", end).alias("record"))
    return whole.union(revisits.select("page_id", "digest", F.concat("header", end).alias("record")))


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's WARC header fields (lower-case names), its HTTP header, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block, end = rest[: int(fields["content-length"])], rest[int(fields["content-length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("the block's length is not the one its header gives")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


_PARSED = "page_id long, digest string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Parse every reconstructed record, verify digests, and resolve revisits to the payload they refer to."""
    small_batches(spark)

    def page(name: str | None) -> int | None:
        inner = name[len("<urn:page:") : -1] if name else "-"
        return None if inner == "-" else int(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for digest, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fields, _, payload = parse(data)
                said, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                if kind == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != said or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} is not the one that was archived")
                row = page(fields["warc-record-id"]), digest, kind, page(fields.get("warc-refers-to")), len(payload) if kind == "response" else None, said
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["page_id", "digest", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    parsed = records(spark, path).mapInArrow(run, _PARSED)
    stored = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads").select("digest", F.octet_length("payload").cast("long").alias("stored_bytes"), base32(F.sha1("payload")).alias("stored_sha1"))
    resolved = parsed.join(stored, "digest", "left")
    size = F.when(F.col("record_type") == "revisit", F.col("stored_bytes")).otherwise(F.col("payload_bytes"))
    sha1 = F.when(F.col("stored_sha1") == F.col("payload_digest"), F.col("stored_sha1")).otherwise(F.raise_error(F.lit("a record's digest differs from its payload's")))
    return resolved.select("page_id", size.alias("payload_bytes"), sha1.alias("payload_digest"), "record_type", "refers_to")


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path, least)
    return read_archive(pages.sparkSession, path)
