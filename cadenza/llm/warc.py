"""WARC archives: a writer on Spark's own commit protocol, and a salvage reader.

An uncompressed WARC record of text is text itself, and ends with two line breaks, so Spark's text sink with
that separator writes valid archives on any shared file system and survives lost executors. The reader
takes archives as bytes, plain or gzipped by member, checks every record, and after a failed check searches for the next valid version
line or member, reporting the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts, small_enough

#: Payloads of fewer bytes are always responses; records in a file at most; groups of copies broadcast at most (about 16 MB).
LEAST_BYTES, RECORDS_PER_FILE, BROADCAST_GROUPS = 100, 2000, 100_000
CRLF = "\r\n"
FIELDS = "archive string, kind string, start long, length long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, note string"
_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in FIELDS.split(", "))])
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_BEGINS = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_URN, _NO_ID = "urn:page:", "none"


def record_text(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column, date: str = "2026-01-01T00:00:00Z") -> Column:
    """One record without its closing blank lines, which the sink adds. Revisits hold the HTTP headers only, with the full length."""
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF * 2))
    block = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    kind = F.when(refers_to.isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    profile = F.when(refers_to.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <{_URN}"), refers_to.cast("string"), F.lit(f">{CRLF}")))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: <{_URN}"), F.coalesce(page_id.cast("string"), F.lit(_NO_ID)), F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), clean,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), digest, F.lit(CRLF), profile,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of pages (page_id, url, html). Of equal payloads of LEAST_BYTES or more, the row with the smallest page_id
    holds the payload; the others revisit it. Rows with a null page_id are responses with an id of their own kind."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    copies = rows.filter(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copies = F.broadcast(copies) if small_enough(copies, BROADCAST_GROUPS) else copies
    marked = rows.join(copies, "digest", "left").withColumn("refers", F.when(F.col("first") < F.col("page_id"), F.col("first")))
    text = record_text(F.col("page_id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers"))
    marked.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:])
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def _urn(value: str) -> int | None:
    """The page of a record's id; a record of a row without one names none."""
    found = re.fullmatch(rf"<{_URN}(-?\d+)>", value)
    return int(found[1]) if found else None


def _record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at a place and its end, or what is wrong with it."""
    if not _VERSION.match(data, at):
        return "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return "headers don't end"
    fields = _headers(data[at:head])
    if not fields.get("content-length", "").isdigit():
        return "no content length"
    end = head + 4 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "block doesn't end at its length"
    block = data[head + 4 : end]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = _headers(http).get("content-length", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = fields.get("warc-type")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or told != str(len(payload))):
        return "payload doesn't match its digest"
    name = fields.get("warc-record-id", "")
    page = _urn(name)
    if page is None and name != f"<{_URN}{_NO_ID}>" or kind not in ("response", "revisit"):
        return "no known type or id"
    return {"kind": "record", "page_id": page, "record_type": kind, "refers_to": _urn(fields.get("warc-refers-to", "")), "payload_digest": digest, "payload_bytes": int(told) if told.isdigit() else None, "payload": payload if kind == "response" else None}, end + 4


_MEMBER = b"\x1f\x8b\x08"


def _member(data: bytes, at: int) -> tuple[list[dict], int] | str:
    """The records and gaps of the gzip member at a place and its end, or what is wrong with it."""
    unzip = zlib.decompressobj(31)
    try:
        raw = unzip.decompress(memoryview(data)[at:])
    except zlib.error:
        return "member is broken"
    if not unzip.eof:
        return "member is broken"
    end = len(data) - len(unzip.unused_data)
    return [row | {"start": at, "length": end - at} for row in _rows(raw, False)], end


def _at(data: bytes, at: int, members: bool) -> tuple[list[dict], int] | str:
    """What can be read at a place, be it a plain record or a member, and its end, or what is wrong there."""
    if members and data.startswith(_MEMBER, at):
        return _member(data, at)
    got = _record(data, at)
    return got if isinstance(got, str) else ([got[0] | {"start": at, "length": got[1] - at}], got[1])


def _rows(data: bytes, members: bool) -> Iterator[dict]:
    """Records and gaps in order; after a failed check the search goes on to the next place from which a whole record or, if wanted, member can be read."""
    begins = _BEGINS if members else _VERSION
    at = 0
    while at < len(data):
        got = _at(data, at, members)
        if isinstance(got, str):
            why, nxt = got, begins.search(data, at + 1)
            while nxt and isinstance(got := _at(data, nxt.start(), members), str):
                nxt = begins.search(data, nxt.start() + 1)
            end = nxt.start() if nxt else len(data)
            yield {"kind": "gap", "start": at, "length": end - at, "note": why}
            if not nxt:
                return
        yield from got[0]
        at = got[1]


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in order, whether it is plain, gzipped by member or both; records of one member have its place and length."""
    return _rows(data, True)


def read_archives(spark: SparkSession, path: str, pattern: str = "part-*", payloads: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap of the archives in path. An archive is one row of bytes, so write archives of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                for row in salvage(content.as_py()):
                    if not payloads:
                        row.pop("payload", None)
                    rows.append(row | {"archive": archive.as_py()})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(run, FIELDS)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as archives into the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null page_id stays null, as response. Payloads under LEAST_BYTES bytes are responses, equal or not; so are repeated rows of the smallest page_id. Very
    long payloads need memory for one archive file. Other columns are ignored; an empty table gives an empty result.
    """
    path = Cuts(spark, "warc").path()
    write_archives(pages, path)
    found = read_archives(spark, path, payloads=False).filter("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
