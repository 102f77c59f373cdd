"""WARC archives: written from pages, read back, and assembled into one row per capture.

Every page gives a request, a response (or a revisit, when another page has the same payload) and a metadata record,
tied by WARC-Concurrent-To. Spark's text writer puts the records into gzip archives of a bounded number of pages, with
the record separator as its line separator, so that writing is committed and retried as any Spark job.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlytics.llm import texts

#: The format's version line, line end and record separator.
VERSION, LINE, RECORD_END = "WARC/1.1", "\r\n", "\r\n\r\n"

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Records in one archive, three to a page; bounds what one reading task holds.
ARCHIVE_RECORDS = 3000

RECORDS = ("record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, "
           "computed string, payload_bytes long, fields map<string,string>, payload string")


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record up to its separator; headers with a null value are left out."""
    lines = [F.lit(f"{VERSION}{LINE}WARC-Type: {kind}{LINE}WARC-Date: 2024-01-01T00:00:00Z{LINE}WARC-Record-ID: "), record_id]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{LINE}{name}: "), value), F.lit("")))
    length = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit(f"{LINE}Content-Length: "), length, F.lit(RECORD_END), block)


def _one_line(value: Column) -> Column:
    """Percent-encodes what would break a header line."""
    for char, code in (("%0D", "\r"), ("%0A", "\n")):
        value = F.replace(value, F.lit(code), F.lit(char))
    return value


def records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """(record): three WARC records per row of `pages`.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the smallest id are responses and the others
    revisit it; rows repeated under the smallest id are all responses, as are rows whose payload has no id at all. A null
    payload is empty; a null URL or id leaves its header or field out.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    rows = pages.select(F.col(id_column).cast("string").alias("page"), F.col(id_column).alias("id"),
                        F.col(url_column).cast("string").alias("url"), F.col(payload_column).alias("payload"))
    rows = rows.withColumn("payload", payload).withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256)).withColumn(
        "bytes", F.octet_length("payload"))
    repeated = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(repeated, "digest", "left")
    urn = lambda kind, page: F.concat(F.lit(f"<urn:{kind}:"), page, F.lit(">"))
    rows = rows.withColumn("row", F.concat(F.coalesce("page", F.lit("null")), F.lit(":"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("again", F.coalesce(F.col("id").isNull() & F.col("first").isNotNull() | (F.col("id") != F.col("first")), F.lit(False)))
    uri, digest, own = ("WARC-Target-URI", _one_line(F.col("url"))), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), urn("capture", F.col("row"))
    http = F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{RECORD_END}")
    typed = lambda x: ("Content-Type", F.lit(x))
    refers = ("WARC-Refers-To-Page", F.col("first").cast("string"))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    capture = F.when(F.col("again"), _record("revisit", own, [uri, digest, refers, profile, typed("application/http;msgtype=response")], http)).otherwise(
        _record("response", own, [uri, digest, typed("application/http;msgtype=response")], F.concat(http, "payload")))
    request = _record("request", urn("request", F.col("row")), [uri, ("WARC-Concurrent-To", own), typed("application/http;msgtype=request")],
                      F.lit(f"GET / HTTP/1.1{RECORD_END}"))
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), "page", F.lit(LINE)), F.lit("")), F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(LINE))
    metadata = _record("metadata", urn("metadata", F.col("row")), [uri, ("WARC-Concurrent-To", own), typed("application/warc-fields")], fields)
    return rows.select(F.explode(F.array(request, capture, metadata)).alias("record"))


def write(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes the archives (gzip) into the folder `path`."""
    records(pages, **columns).write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def _inflate(data: bytes) -> bytes:
    """The content of a gzip file of one or several members; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _pairs(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n"))
    return {k.strip().decode().lower(): v.strip().decode(errors="replace") for k, sep, v in pairs if sep}


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of every record of an archive."""
    data, at = _inflate(archive), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = _pairs(data[at:end])
        start, size = end + 4, int(headers["content-length"])
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, data[start:start + size]
        at = start + size + 4


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    head, _, body = block.partition(b"\r\n\r\n") if kind in ("response", "revisit", "request") else (b"", b"", block)
    fields = _pairs(block) if kind == "metadata" else _pairs(head)
    declared = headers.get("warc-payload-digest")
    computed = hashlib.sha256(body).hexdigest() if kind == "response" else None
    return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to-page"),
            headers.get("warc-target-uri"), declared.partition(":")[2] if declared else None, computed, len(body),
            list(fields.items()), body.decode(errors="replace") if with_payload and kind == "response" else None)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in `path`: headers, payload length and, for responses, the payload.

    `digest` is the declared payload digest, `computed` the SHA-256 of the payload that was read (responses only). A
    file that is no archive, or is cut off, fails.
    """
    def batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip(
            [c.split()[0] for c in RECORDS.split(", ")],
            [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()])])
        for batch in files:
            for content in batch.column(0):
                rows = [_row(h, b, with_payload) for h, b in parse(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(batches, RECORDS)


def transactions(read_records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, type, uri, digest, refers_to, payload, request, metadata).

    request and metadata are the records concurrent to the capture; of several, the one with the smallest record id. A
    capture without them has null there; requests and metadata without a capture are left out. Captures that share a
    record id each give a row.
    """
    captures = read_records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", "type", "uri", "digest", "computed", "refers_to", "payload_bytes", "payload")

    def companion(kind: str) -> DataFrame:
        # One per capture before the join, combined on the map side.
        return read_records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(
            F.min_by(F.struct("record_id", "fields"), "record_id").alias(kind))

    return captures.join(companion("request"), "record_id", "left").join(companion("metadata"), "record_id", "left")


def captures(pages: DataFrame, path: str, with_payload: bool = True, **columns: str) -> DataFrame:
    """Writes `pages` as archives into `path` and reads them back as transactions."""
    write(pages, path, **columns)
    return transactions(read(texts.prepare(pages.sparkSession), path, with_payload))
