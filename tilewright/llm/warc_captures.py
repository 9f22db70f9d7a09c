"""WARC archives: writing captures, reading records, and assembling transactions (operator 1).

Writing: every page becomes a request, a response (or a revisit of a response
with the same payload) and a metadata record, linked by ``WARC-Concurrent-To``.
Spark's text writer stores them with the record end of the format as its line
separator, so archives go to any file system Spark writes to, one gzip member
a file, and a lost task is run again.

Reading: archives are parsed record by record from their Content-Length, as a
stream, so beside its file a task holds one record's block at a time.

Assembly: the records of one capture are those that ``WARC-Concurrent-To``
connects, in either direction, directly or through one record between.  A
capture is named after its response (or revisit); records connected to none
make a capture of their own, named after the record they point to.  One nested
row comes out per capture: the request, the response or revisit, and the list
of metadata records.  Nested records hold headers and sizes, not bodies, so
the row is bounded by the number of records.

Null html counts as empty.  A null url gives no target.  Every row is a capture
of its own, repeated rows and rows without an id too.  Of equal payloads the rows
with the largest id (null is least) are responses, the others revisit one of them;
without any id all are responses.  An empty table gives an empty archive and no captures.

Archive files take about ``FILE_BYTES`` of records: pages are written by classes of
size, each a factor 16 wide, and the records of a file follow from its class's mean, so a file
stays below 1 GB whatever its pages.  A task of the reader holds one file, and Spark's reader
of whole files ends at 2 GB, so larger archives of others have to be cut before.

A record's id follows from the page and from a number of the row that no other record needs to know.  Only
responses that revisits refer to are named by page, URL and payload alone; if
such a row is there several times, its copies are numbered instead of the rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, saved, scratch, table

LEAST_REVISIT = 1000
#: Bytes of records in one archive file, about, and compressed bytes that are inflated at a time.
FILE_BYTES, CHUNK = 64_000_000, 16_384
#: Repeated payloads that are broadcast at most (a digest and two numbers each).
MAX_BROADCAST = 200_000
#: Sizes at which classes of pages end.
CLASSES = (1 << 16, 1 << 20, 1 << 24)
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(kind: str, *parts: Column) -> Column:
    key = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    cut = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple[str, Column | None]], block: Column) -> Column:
    """One record without its end; a field whose value is null is left out."""
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n")))
    return F.concat(*lines, block)


def write_captures(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> None:
    """Writes the records of every page (page_id, url, html)."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        # white space and control characters have no place in a header
        F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    # The response of each repeated payload.  Only digests are shuffled here, summed in the scan's
    # tasks first; a payload that a third of all pages share is one row afterwards.
    bounds = [0, *CLASSES, 1 << 40]
    of_class = [(F.col("size") >= low) & (F.col("size") < high) for low, high in zip(bounds, bounds[1:])]
    sums = [x for k, c in enumerate(of_class) for x in (F.count_if(c).alias(f"n{k}"), F.sum(F.when(c, F.col("size"))).alias(f"bytes{k}"))]
    seen = pages.agg(*sums).first()
    each = pages.where(F.col("size") >= least_revisit).groupBy(F.col("sha1").alias("first_sha1"), "page_id", "url").agg(F.count("*").alias("copies"))
    first = each.groupBy("first_sha1").agg(F.max_by(F.struct("page_id", "url", "copies"), F.struct("page_id", "url")).alias("top"), F.sum("copies").alias("times"))
    first = first.where("times > 1 AND top.page_id IS NOT NULL").select("first_sha1", F.col("top.page_id").alias("response_page"), F.col("top.url").alias("response_url"), F.col("top.copies").alias("response_copies"))
    first = saved(first, "repeated-payloads")
    copied = not first.where("response_copies > 1").isEmpty()
    # Whole pages travel only where the repeated digests are too many to be sent to them.
    first = F.broadcast(first) if first.count() <= MAX_BROADCAST else first
    rows = pages.join(first, (F.col("sha1") == F.col("first_sha1")) & (F.col("size") >= least_revisit), "left")
    named = F.coalesce((F.col("page_id") == F.col("response_page")) & F.col("url").eqNullSafe(F.col("response_url")), F.lit(False))
    rows = rows.withColumn("row", F.when(named, F.lit(0)).otherwise(F.monotonically_increasing_id() + 1).cast("long"))
    if copied:  # equal rows: one is taken, and made again as often as there were
        several = F.coalesce(named & (F.col("response_copies") > 1), F.lit(False))
        again = rows.where(several).groupBy("page_id", "url", "sha1", "size", "first_sha1", "response_page", "response_url", "response_copies").agg(F.first("html").alias("html"))
        again = again.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("response_copies") - 1)))
        rows = rows.where(~several).unionByName(again)
    numbers = [seen[f"n{k}"] for k in range(len(of_class))]
    for k, (c, n) in enumerate(zip(of_class, numbers)):
        if n or k == 0:  # an empty table gives an empty archive
            _write_records(rows if n == sum(numbers) else rows.where(c), path, max(1, FILE_BYTES // ((seen[f"bytes{k}"] or 0) // max(n, 1) + 1500)))


def _write_records(rows: DataFrame, path: str, most: int) -> None:
    """Adds the records of these rows to the archives at ``path``, at most ``most`` pages to a file."""
    revisit = F.col("response_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_page"))
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    uri, page = F.col("url"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    key = (F.col("row"), F.col("page_id"), F.col("url"), F.col("sha1"))
    response_id = _record_id("response", *key)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)]
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"://([^/?#]*)", 1)
    place = F.regexp_extract(F.coalesce(uri, F.lit("")), r"://[^/?#]*([^#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", *key)), *common, ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", response_id),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, _record_id("response", F.lit(0), F.col("response_page"), F.col("response_url"), F.col("sha1")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", *key)), *common, ("WARC-Concurrent-To", response_id), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), page, F.lit("\r\n")),
    )
    (
        rows.select(F.concat_ws(END, request, response, metadata).alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", most)
        .mode("append")
        .text(path)
    )


class _Inflated(io.RawIOBase):
    """The bytes of concatenated gzip members, or of plain content, without holding them all."""

    def __init__(self, content: bytes):
        self.content, self.at = content, 0
        self.plain = content[:2] != b"\x1f\x8b"
        self.inner = None if self.plain else zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        out = b""
        if self.plain:
            out = self.content[self.at : self.at + len(target)]
            self.at += len(out)
        while not out and not self.plain:
            if self.inner.eof:  # the next member begins where this one ended
                self.at -= len(self.inner.unused_data)
                self.inner = zlib.decompressobj(31)
            data = self.inner.unconsumed_tail
            if not data:
                data = self.content[self.at : self.at + CHUNK]
                self.at += len(data)
            if not data:
                break
            out = self.inner.decompress(data, len(target))
        target[: len(out)] = out
        return len(out)


def records(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """The records of an archive: header fields by lower-case name, and the block."""
    stream = io.BufferedReader(_Inflated(content), 1 << 16)
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        fields: dict[str, list[str]] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(fields["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive was cut short")
        yield fields, block


def _hex(digest: str | None) -> str | None:
    """A digest field in lower-case hex, whether it was written in hex or in base 32."""
    if digest is None:
        return None
    value = digest.rpartition(":")[2]
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else value.lower()


RECORD = "type string, id string, concurrent_to array<string>, refers_to string, uri string, date string, content_type string, http_status int, page_id long, payload_bytes long, payload_digest string, payload binary"


def _parsed(fields: dict[str, list[str]], block: bytes, with_payload: bool) -> tuple:
    one = lambda name: fields.get(name, [None])[0]
    kind = one("warc-type")
    status = page = size = digest = payload = None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if m := re.match(rb"HTTP/\S+ (\d+)", head):
            status = int(m[1])
        if kind == "response":
            size, digest, payload = len(body), hashlib.sha1(body).hexdigest(), body
        else:
            digest = _hex(one("warc-payload-digest"))
            if m := re.search(rb"(?im)^content-length:\s*(\d+)", head):
                size = int(m[1])
    elif kind == "metadata" and (m := re.search(rb"(?im)^page-id:[ \t]*(-?\d+)", block)):
        page = int(m[1])
    links = [x for value in fields.get("warc-concurrent-to", []) for x in value.split()]
    return kind, one("warc-record-id"), links, one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), one("content-type"), status, page, size, digest, payload if with_payload else None


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives under ``path``."""
    types = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in records(content.as_py()):
                    rows.append(_parsed(fields, block, with_payload))
                    size += len(block) if with_payload else 100
                    if size > 4_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, RECORD)


def capture_ids(records_: DataFrame) -> DataFrame:
    """Adds ``capture``: the record that names the capture a record belongs to."""
    main = F.col("type").isin("response", "revisit")
    links = records_.select("id", "type", F.explode("concurrent_to").alias("to"))
    # A response that points at its request names it too; such links are turned round.
    turned = links.where(main).groupBy(F.col("to").alias("turned_id")).agg(F.min("id").alias("turned_capture"))
    direct = F.element_at(F.array_sort("concurrent_to"), 1)
    rows = records_.withColumn("pointed", F.when(~main & (F.size("concurrent_to") > 0), direct))
    rows = rows.join(turned, F.col("id") == F.col("turned_id"), "left").drop("turned_id")
    # The record pointed at may itself belong to a response that points at it.
    far = turned.select(F.col("turned_id").alias("far_id"), F.col("turned_capture").alias("far_capture"))
    rows = rows.join(far, F.col("pointed") == F.col("far_id"), "left").drop("far_id")
    return rows.withColumn("capture", F.when(main, F.col("id")).otherwise(F.coalesce("turned_capture", "far_capture", "pointed", "id"))).drop("turned_capture", "far_capture", "pointed")


def assemble(records_: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata records.

    ``refers_to_page`` is the page of the response that a revisit refers to.
    """
    rows = saved(records_.where(F.col("type").isin("request", "response", "revisit", "metadata")).drop("payload"), "warc-records")
    rows = capture_ids(rows)
    page_of = rows.where("page_id IS NOT NULL").groupBy(F.col("capture").alias("of_capture")).agg(F.min("page_id").alias("of_page"))
    # Many revisits may refer to one response; they are the large side of this join.
    revisits = rows.where("type = 'revisit'").join(page_of, F.col("refers_to") == F.col("of_capture"), "left")
    revisits = revisits.withColumnRenamed("of_page", "refers_to_page").drop("of_capture")
    rows = revisits.unionByName(rows.where("type <> 'revisit'").withColumn("refers_to_page", F.lit(None).cast("long")))
    part = F.struct("id", "uri", "date", "content_type", "http_status", "page_id", "payload_bytes", "payload_digest", "refers_to", "refers_to_page")
    main = F.col("type").isin("response", "revisit")
    return rows.groupBy("capture").agg(
        F.min(F.when(F.col("type") == "request", part)).alias("request"),
        F.min(F.when(main, F.struct(F.col("type").alias("record_type"), part.alias("record")))).alias("response"),
        F.sort_array(F.collect_set(F.when(F.col("type") == "metadata", part))).alias("metadata"),
    )


def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, reads them back and assembles the captures."""
    path = scratch(spark, "warc")
    write_captures(table(spark, sf_dir, "pages"), path)
    record = "response.record."
    return assemble(read_records(spark, path)).select(
        F.col("metadata")[0]["page_id"].alias("page_id"),
        F.col(record + "payload_bytes").alias("payload_bytes"),
        F.col(record + "payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col(record + "refers_to_page").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_page FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last_page IS NOT NULL AND page_id IS DISTINCT FROM last_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last_page THEN last_page END AS refers_to
FROM m
"""
