"""WARC archives: writing captures, reading them back, and transaction assembly.

A capture is three records: the request, the response (or a revisit of an equal
payload) and its metadata. Requests and metadata name their response in
WARC-Concurrent-To, and joins through it give one nested row a capture. Spark's
text writer makes the archives, so they land wherever Spark can write; a record's
end is that writer's line separator. Each file is one gzip stream; the reader also
takes files of many gzip members, or uncompressed ones.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "kind string, record_id string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, payload_bytes long, page_id long, payload string"


def _record(kind: str, fields: dict[str, str], block) -> F.Column:
    """One record's text: header lines that aren't null, an empty line, the block."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_captures(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", least: int = 100, per_file: int = 5000, file_bytes: int = 1 << 26) -> None:
    """Archive pages (page_id, url, html), the payload being html in UTF-8 (null: empty).

    Of pages with equal payloads of at least `least` bytes, that with the smallest
    page_id is a response and the others revisit it; smaller payloads are all
    responses. A null page_id never names the response, unless all are null: then
    each is a response. Repeated rows of the smallest page_id are responses each.
    Only digests, not payloads, are grouped. A file holds `per_file` captures and
    `file_bytes` of payload at most, or one capture: pages are written by size, in
    bands that differ in how many go to a file.
    """
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low, high = -1, 1 << 14
    while low < longest:
        # equal payloads lie in one band
        _write_band(pages.filter(F.coalesce(F.octet_length("html"), F.lit(0)).between(low + 1, high)), f"{path}/to-{high}", date, least, max(1, min(per_file, file_bytes // high)))
        low, high = high, high << 3


def _write_band(pages: DataFrame, path: str, date: str, least: int, per_file: int) -> None:
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x20\x7F]", "%20")  # noqa: E731  a header is one line
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), clean(F.col("url")).alias("uri"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    classes = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    rows = rows.join(classes, "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    capture = lambda kind, page: F.concat(F.lit(f"<urn:x-capture:{kind}:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))
    # a response's id follows from its page and digest, so revisits can name it
    own = F.when(F.col("again"), capture("revisit", F.col("page_id"))).otherwise(capture("response", F.col("page_id")))
    when = F.lit(date)
    shared = {"WARC-Target-URI": F.col("uri"), "WARC-Date": when}
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest"))}
    http = "application/http; msgtype=response"
    response = _record("response", {"WARC-Record-ID": own, **shared, **digest, "Content-Type": F.lit(http)}, F.concat(head, "body"))
    revisit = _record("revisit", {"WARC-Record-ID": own, **shared, **digest, "WARC-Profile": F.lit(REVISIT_PROFILE), "WARC-Refers-To": capture("response", F.col("first")), "Content-Type": F.lit(http)}, head)
    side = lambda kind: {"WARC-Record-ID": capture(kind, F.col("page_id")), "WARC-Concurrent-To": own, **shared}
    asked = F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record("request", {**side("request"), "Content-Type": F.lit("application/http; msgtype=request")}, asked)
    noted = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", {**side("metadata"), "Content-Type": F.lit("application/warc-fields")}, noted)
    records = rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * per_file).text(path)


def _open(content: bytes):
    """The file's bytes as a stream, any gzip members decompressed as they are read."""
    if content[:2] != b"\x1f\x8b":
        return io.BufferedReader(io.BytesIO(content))

    class Members(io.RawIOBase):
        def __init__(self):
            self.left, self.zip = memoryview(content), zlib.decompressobj(31)

        def readable(self):
            return True

        def readinto(self, into):
            while True:
                if self.zip.eof:
                    self.left = memoryview(self.zip.unused_data + bytes(self.left))
                    if not self.left:
                        return 0
                    self.zip = zlib.decompressobj(31)
                feed = self.zip.unconsumed_tail or bytes(self.left[: 1 << 16])
                if not self.zip.unconsumed_tail:
                    self.left = self.left[1 << 16 :]
                if got := self.zip.decompress(feed, len(into)):
                    into[: len(got)] = got
                    return len(got)
                if not feed and not self.zip.eof:
                    return 0

    return io.BufferedReader(Members(), 1 << 16)


def parse_records(content: bytes):
    """(headers with lower-case names, block) of each record; a block is as long as its header says."""
    stream = _open(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives under `path`; payloads are checked against their digest."""
    bounded_batches(spark, rows=1)

    def row(headers, block):
        kind, page, payload, size = headers["warc-type"], None, None, None
        stated = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            if kind == "response" and (len(payload) != size or stated and hashlib.sha256(payload).hexdigest() != stated):
                raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its length or digest")
        elif kind == "metadata":
            page = dict(x.split(b": ", 1) for x in block.split(b"\r\n") if b": " in x).get(b"page-id")
        text = payload.decode("utf-8", "replace") if with_payload and kind == "response" else None
        names = ("warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date")
        return (kind, *map(headers.get, names), stated, size, int(page) if page else None, text)

    def run(batches):
        kinds = [*[pa.string()] * 7, pa.int64(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def ready():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in parse_records(content.as_py()):
                    rows.append(row(headers, block))
                    size += len(block) if with_payload else 100
                    if size > 1 << 22:
                        yield ready()
                        rows, size = [], 0
        yield ready()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit, with the request and metadata concurrent to it.

    Requests and metadata without a capture in the archives are left out; a
    capture without them has null there. Several that name one capture count once.
    """
    by = lambda kind, *columns: records.filter(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first(F.struct(*columns), ignorenulls=True).alias(kind))
    captures = records.filter(F.col("kind").isin("response", "revisit"))
    parts = by("request", F.col("record_id").alias("request_id"), "uri"), by("metadata", F.col("record_id").alias("metadata_id"), "page_id")
    nested = captures.drop("concurrent_to", "page_id").join(parts[0], "record_id", "left").join(parts[1], "record_id", "left")
    return nested.withColumn("refers_to_page", F.regexp_extract("refers_to", r"^<urn:x-capture:response:(\d+|-\d+):", 1).try_cast("long"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive `pages`, read the archives back and assemble: page_id, payload_bytes, payload_digest,
    record_type, refers_to. An empty table gives an empty result; other columns are not read."""
    path = path or new_path(pages.sparkSession, "warc")
    write_captures(pages, path)
    whole = assemble(read_records(pages.sparkSession, path, with_payload=False))
    return whole.select(F.col("metadata.page_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
