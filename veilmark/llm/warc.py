"""WARC archives: writing, reading back, and resolving repeated payloads to revisit records.

Archives are gzip files of WARC 1.1 records written by Spark's text writer (records end with the
separator CRLF CRLF) and read by its binary reader, so any file system that Spark reaches will do; a file holds
at most RECORDS_A_FILE records of SMALL bytes, or FILE_BYTES of larger ones, and is parsed as a stream by Content-Length. A file
is one gzip member, so a reader goes through it from its start; there is no warcinfo record, and the date is DATE, since pages
carry none. Resolution reads the
headers alone, shuffles them by payload digest, takes the smallest id of each digest (combined
map-side, so one very common payload costs a task one row) and joins revisits to it. The
deduplicated archives get fresh headers: revisit records refer to the response and carry no payload.

Defined cases: null html counts as an empty payload; a null url has no target header; of records with equal
payload and equal page_id the one with the smallest record id is the response; null ids sort last; a page of any size is one record, up to the
2 GB that a string of Spark holds; columns other than page_id, url and html are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch_path, small, stage

END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS_A_FILE, SMALL, FILE_BYTES = 4000, 1 << 16, 1 << 28


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def response_record(page_id: int | None, url: str | None, html: str | None, serial: str) -> str:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{serial}>", f"WARC-Date: {DATE}"]
    head += ([] if url is None else [f"WARC-Target-URI: {_header_text(url)}"]) + [f"X-Page-ID: {page_id}"] * (page_id is not None)
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head) + END + (http + payload).decode("utf-8", "surrogatepass")


def revisit_record(fields: dict[str, str], refers_to: int | None, refers_id: str) -> str:
    http = (HTTP + b"\r\n").decode()
    head = ["WARC/1.1", "WARC-Type: revisit", f"WARC-Record-ID: {fields['warc-record-id']}", f"WARC-Date: {DATE}"]
    head += [f"{name}: {fields[name.lower()]}" for name in ("WARC-Target-URI", "X-Page-ID") if name.lower() in fields]
    head += [f"WARC-Refers-To: {refers_id}", f"WARC-Profile: {PROFILE}"] + [f"X-Refers-To-Page: {refers_to}"] * (refers_to is not None)
    head += [f"WARC-Payload-Digest: {fields['warc-payload-digest']}", f"X-Payload-Length: {fields['x-payload-length']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head) + END + http


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of one archive, as a stream."""
    f = gzip.GzipFile(fileobj=io.BytesIO(content))
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := f.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, f.read(int(fields["content-length"]))


def _write(records: DataFrame, path: str, most: int) -> None:
    """Write records(value), at most so many a file."""
    records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)


def _kinds(largest: int) -> dict[str, int]:
    """Folders of archives and how many records a file of theirs holds; records over SMALL bytes lie apart, where there are any."""
    return {"small": RECORDS_A_FILE} | ({"large": max(1, FILE_BYTES // largest)} if largest > SMALL else {})


def _bytes() -> F.Column:
    """Bytes that a page's record does not exceed: payload, escaped url and headers."""
    return F.coalesce(F.octet_length("html"), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1500


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


_HEADERS = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARROW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; the digest of a response is checked against its block."""

    def parse(batches):
        number = lambda fields, name: int(fields[name]) if name in fields else None
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in read_records(content.as_py()):
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and payload_digest(block.partition(b"\r\n\r\n")[2]) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    rows.append((fields["warc-record-id"], number(fields, "x-page-id"), int(fields["x-payload-length"]), digest, fields["warc-type"], number(fields, "x-refers-to-page")))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

    return _archives(spark, path).mapInArrow(parse, _HEADERS)


def write_archives(pages: DataFrame, path: str) -> int:
    """A response record for every row of pages(page_id, url, html); the bytes that no record exceeds."""

    def records(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                yield pa.RecordBatch.from_pydict({"value": [response_record(r["page_id"], r["url"], r["html"], str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['page_id']} {r['k']}"))) for r in rows]}, schema=pa.schema([("value", pa.string())]))

    largest = pages.agg(F.max(_bytes())).first()[0] or 0
    numbered = pages.select(F.col("page_id").cast("long"), "url", "html", F.monotonically_increasing_id().alias("k"))
    for kind, most in _kinds(largest).items():
        rows = numbered.where(_bytes() <= SMALL if kind == "small" else _bytes() > SMALL)
        _write(rows.mapInArrow(records, "value string"), f"{path}/{kind}", most)
    return largest


def resolve_revisits(headers: DataFrame, min_payload: int = 0) -> DataFrame:
    """(record_id, refers_to, refers_id) of the records that repeat an earlier payload of at least min_payload bytes."""
    known = headers.where(F.col("payload_bytes") >= min_payload)
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    first = known.groupBy("payload_digest", "payload_bytes").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    both = known.join(first, ["payload_digest", "payload_bytes"]).where("record_id <> first.record_id")
    return both.select("record_id", F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_id"))


def write_deduplicated(spark: SparkSession, source: str, revisits: DataFrame, path: str, largest: int) -> None:
    """Copy archives with the revisits replaced; payloads are only shuffled where revisits are too many to broadcast."""
    arrow = pa.schema([("record_id", pa.string()), ("value", pa.string()), ("short", pa.string())])

    def split(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in read_records(content.as_py()):
                    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items())])
                    rows.append((fields["warc-record-id"], head + END + block.decode("utf-8", "surrogatepass"), head))
                    held += len(block)
                    if len(rows) == 128 or held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=arrow)

    def fresh(batches):
        for batch in batches:
            out = []
            for value, head, refers_to, refers_id in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if refers_id is not None:
                    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
                    value = revisit_record(fields, refers_to, refers_id)
                out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    repeats = small(revisits)
    for kind, most in _kinds(largest).items():
        records = _archives(spark, f"{source}/{kind}").mapInArrow(split, "record_id string, value string, short string")
        both = records.join(repeats, "record_id", "left")
        both = both.select(F.when(F.col("refers_id").isNull(), F.col("value")).alias("value"), F.when(F.col("refers_id").isNotNull(), F.col("short")).alias("short"), "refers_to", "refers_id")
        _write(both.mapInArrow(fresh, "value string"), f"{path}/{kind}", most)


def warc_dedup(pages: DataFrame, min_payload: int = 0) -> tuple[DataFrame, str]:
    """(records, path): archives of pages with repeats as revisits, read back, and where they lie.

    records has record_id, page_id, payload_bytes, payload_digest, record_type and refers_to.
    """
    spark = pages.sparkSession
    raw, done = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc-dedup")
    largest = write_archives(pages, raw)
    headers = stage(read_headers(spark, raw).select("record_id", "page_id", "payload_bytes", "payload_digest"), "warc-headers")
    revisits = stage(resolve_revisits(headers, min_payload), "warc-revisits")
    write_deduplicated(spark, raw, revisits, done, largest)
    discard(spark, raw, headers, revisits)
    return read_headers(spark, done), done
