"""WARC archives of pages: written as records, read back, and assembled into captures.

Each capture is three records: a request, a response (or a revisit of an equal
payload seen elsewhere) and metadata; the first and the last name the second in
WARC-Concurrent-To. Archives are written by Spark's text writer, whose commit
protocol survives lost executors on any file system, and read as binary files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
_NAMESPACE = "urn:uuid:"

RECORDS = (
    "record_id string, record_type string, concurrent_to string, target_uri string, page_id long, "
    "refers_to string, refers_to_page long, payload binary, payload_bytes long, payload_digest string, "
    "declared_digest string"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(part: str) -> Column:
    """A UUID of the row and the part of the capture."""
    h = F.md5(F.concat_ws(":", F.lit(part), "_uid"))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit(f"<{_NAMESPACE}"), F.concat_ws("-", *pieces), F.lit(">"))


def with_originals(pages: DataFrame) -> DataFrame:
    """Add the digest of each payload and, for all but the largest page_id of equal payloads, that page_id.

    Digests are counted before they are shuffled, and only those that repeat
    are joined back; a payload that very many pages share is a skewed join,
    which adaptive execution splits.
    """
    digested = pages.withColumn("_sha1", F.sha1(F.col("_payload").cast("binary")))
    repeated = (
        digested.groupBy("_sha1")
        .agg(F.max("page_id").alias("_largest"), F.count("*").alias("_n"))
        .where("_n > 1 AND _largest IS NOT NULL")
        .select("_sha1", "_largest")
    )
    smaller = F.col("page_id").isNull() | (F.col("page_id") < F.col("_largest"))
    return digested.join(repeated, "_sha1", "left").withColumn("_original", F.when(smaller, F.col("_largest"))).drop("_largest")


def archive_records(pages: DataFrame) -> DataFrame:
    """One row ``value`` per WARC record of the ``pages (page_id, url, html)``.

    A null html is an empty payload, a null url an empty one. Line ends in urls,
    which no header can hold, are percent-encoded.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("_url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_payload"),
    )
    known = with_originals(rows).withColumn("_uid", F.monotonically_increasing_id())
    uri, page = F.col("_url"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    path = F.regexp_replace(F.regexp_extract("_url", r"^[a-z]+://[^/]*(.*)$", 1), "^$", "/")
    length = F.octet_length("_payload").cast("string")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n")
    )
    request = F.concat(
        F.lit("GET "), F.regexp_replace(path, " ", "%20"), F.lit(" HTTP/1.1\r\nHost: "),
        F.regexp_extract("_url", r"^[a-z]+://([^/]*)", 1), F.lit("\r\n\r\n"),
    )
    is_revisit = F.col("_original").isNotNull()
    main, digest = F.col("_main"), F.concat(F.lit("sha1:"), F.col("_digest"))
    meta = F.concat(
        F.lit("page-id: "), page, F.lit("\r\npayload-bytes: "), length,
        F.when(is_revisit, F.concat(F.lit("\r\nrefers-to-page: "), F.col("_original").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\n"),
    )
    date = ("WARC-Date", F.lit(RECORD_DATE))
    target = ("WARC-Target-URI", uri)

    def record(kind: Column, block: Column, *headers: tuple[str, Column | None]) -> Column:
        fields = [("WARC-Type", kind), date, target, *headers, ("Content-Length", F.octet_length(block).cast("string"))]
        lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields]
        return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), block, F.lit("\r\n"))

    identified = known.withColumns({"_main": _record_id("main"), "_digest": _base32("_sha1")})
    profile = F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    records = F.array(
        record(
            F.lit("request"), request,
            ("WARC-Record-ID", _record_id("request")), ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ),
        record(
            F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
            F.when(is_revisit, http).otherwise(F.concat(http, F.col("_payload"))),
            ("WARC-Record-ID", main), ("WARC-Payload-Digest", digest), ("WARC-Profile", profile),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ),
        record(
            F.lit("metadata"), meta,
            ("WARC-Record-ID", _record_id("metadata")), ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/warc-fields")),
        ),
    )
    return identified.select(F.explode(records).alias("value"))


def _base32(hex_col: str) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five digits are four signs of five bits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    number = f"CAST(conv(substring({hex_col}, g * 5 - 4, 5), 16, 10) AS INT)"
    signs = ", ".join(f"substring('{alphabet}', (shiftright(v, {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return F.expr(
        f"array_join(transform(transform(sequence(1, 8), g -> {number}), v -> concat({signs})), '')"
    )


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write gzip-compressed WARC files, each from one task and of bounded size, to a shared folder.

    The size bound is on rows, by the mean size of a record, as the writer can
    split its files by rows only.
    """
    sizes = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes")).first()
    rows = max(3, 3 * int(ARCHIVE_BYTES * sizes["n"] / max(1, sizes["bytes"] or 1)))
    writer = archive_records(pages).write.option("lineSep", "\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", rows).text(folder)


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.IGNORECASE)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    view, at = memoryview(data), 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = data[at:end]
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = _LENGTH.search(head)
        if not head.startswith(b"WARC/") or not length:
            raise ValueError(f"no WARC record at byte {at}")
        start = end + 4
        at = start + int(length[1])
        if at > len(data):
            raise ValueError(f"record at byte {end} is cut off")
        yield headers, view[start:at]


def _unpacked(data: bytes) -> bytes:
    """Content of one or many gzip members in a row; anything else as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(parts)


def _fields(block: memoryview) -> dict[str, str]:
    lines = bytes(block).decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def _row(headers: dict[str, str], block: memoryview) -> tuple:
    kind = headers.get("warc-type", "")
    page = refers_page = payload = size = digest = None
    if kind in ("response", "revisit"):
        head, _, body = bytes(block).partition(b"\r\n\r\n")
        length = _LENGTH.search(head)
        size = int(length[1]) if length else None
        if kind == "response":
            payload, size, digest = body, len(body), sha1_base32(body)
    elif kind == "metadata":
        fields = _fields(block)
        page = int(fields["page-id"]) if fields.get("page-id") else None
        refers_page = int(fields["refers-to-page"]) if fields.get("refers-to-page") else None
    declared = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"),
        page, headers.get("warc-refers-to"), refers_page, payload, size, digest, declared,
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORDS.split(", ")])
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            weight = 0
            for headers, block in parse_records(_unpacked(content.as_py())):
                rows.append(_row(headers, block))
                weight += len(block)
                if weight > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, weight = [], 0
            if rows:
                yield _batch(rows, schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in a folder, plain or gzip, with columns ``RECORDS``.

    A file is read by one task in one piece, so archives should be of bounded
    size, as those of ``write_archives`` are. Damaged archives are an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("content").mapInArrow(_parse, RECORDS)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit, with the requests and metadata that are concurrent to it.

    A capture without a request or metadata has empty lists there; requests and
    metadata that name no capture are left out. Lists are ordered by record id.
    """
    captures = records.where(F.col("record_type").isin("response", "revisit"))
    others = records.where(F.col("record_type").isin("request", "metadata"))
    part = F.struct("record_id", "target_uri", "page_id", "refers_to_page")

    def listed(kind: str, name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, part))).alias(name)

    joined = others.groupBy(F.col("concurrent_to").alias("_main")).agg(
        listed("request", "requests"), listed("metadata", "metadata")
    )
    empty = F.array().cast(joined.schema["requests"].dataType)
    capture = F.struct(
        "record_id", "record_type", "target_uri", "payload", "payload_bytes",
        F.coalesce("payload_digest", "declared_digest").alias("payload_digest"),
        (F.col("payload_digest").isNull() | F.col("payload_digest").eqNullSafe(F.col("declared_digest"))).alias("digest_holds"),
    )
    return captures.join(joined, captures["record_id"] == joined["_main"], "left").select(
        capture.alias("capture"),
        F.coalesce("requests", empty).alias("requests"),
        F.coalesce("metadata", empty).alias("metadata"),
    )
