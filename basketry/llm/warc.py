"""WARC archives of web pages: segmented records out, reassembled pages back in.

Writing: a page becomes a ``response`` record whose HTTP body has chunked framing, or a ``revisit``
record if a page with the same payload and a larger id exists. Blocks longer than ``SEGMENT_BYTES``
are cut into a first segment and ``continuation`` records. Reading: continuation records are
grouped by their origin, ordered by segment number, checked against the total length, and the
chunks are decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

VERSION = b"WARC/1.1"
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
# Records per archive file: with segments of bounded length, a file fits into one row of a task.
RECORDS_PER_FILE = 400
DATE = b"2024-01-01T00:00:00Z"  # given to every record, so that archives can be compared
_END = "\r\n\r\n"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, a cut body is an error."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is cut")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut")
        out.append(body[at : at + n])
        at += n + 2


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(b"%s: %s\r\n" % f for f in [*fields, (b"Content-Length", b"%d" % len(block))])
    return VERSION + b"\r\n" + head + b"\r\n" + block


def record_name(page: int | None, payload: bytes) -> str:
    """The record id of a page; a revisit, which has the same payload, can name its original by it."""
    return f"urn:page:{'' if page is None else page}:{bare_digest(payload)}"


def page_records(
    record_id: str, url: str | None, payload: bytes, original: str | None, segment: int
) -> list[bytes]:
    """The records of one page without their closing line ends. ``original``: the record revisited."""
    kind = b"revisit" if original else b"response"
    fields = [
        (b"WARC-Type", kind),
        (b"WARC-Record-ID", f"<{record_id}>".encode()),
        (b"WARC-Date", DATE),
        (b"WARC-Payload-Digest", b"sha1:" + bare_digest(payload).encode()),
        (b"Content-Type", b"application/http; msgtype=response"),
    ]
    if url:
        fields.append((b"WARC-Target-URI", " ".join(url.split()).encode()))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if original:
        fields += [
            (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            (b"WARC-Refers-To", f"<{original}>".encode()),
        ]
        return [_record(fields, http + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [_record(fields, block)]
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    records = [_record([*fields, (b"WARC-Segment-Number", b"1")], cuts[0])]
    for i, cut in enumerate(cuts[1:], 2):
        more = [
            (b"WARC-Type", b"continuation"),
            (b"WARC-Record-ID", f"<{record_id}/segment/{i}>".encode()),
            (b"WARC-Date", DATE),
            (b"WARC-Segment-Number", b"%d" % i),
            (b"WARC-Segment-Origin-ID", f"<{record_id}>".encode()),
        ]
        if i == len(cuts):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        records.append(_record(more, cut))
    return records


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of one archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:end].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        start, n = end + 4, int(fields["content-length"])
        if start + n + 4 > len(data) or data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        yield fields, data[start : start + n]
        at = start + n + 4


def originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, digest, original``: the largest page id with the same payload, per distinct page.

    Pages of one payload are counted together before the shuffle and met again as narrow rows, so
    a payload that a third of all pages share is split like any skewed join side.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"), (F.octet_length(body) >= min_bytes).alias("counts"))
    best = keyed.filter("counts").groupBy("digest").agg(F.max("page_id").alias("original"))
    return keyed.join(best, "digest", "left").select("page_id", "digest", "original").distinct()


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT_BYTES
) -> None:
    """Write one or more records for every row of ``pages`` (page_id, url, html) to ``path``.

    NULL html is an empty payload, NULL url gives no target. Rows repeated under one id and payload
    are all written, under one record id, and are of one type. A NULL id is the smallest and never an original. Gzip
    archives are written by Spark, so a lost executor leaves no half-written file behind.
    """
    first = originals(pages, min_bytes).toDF("__page", "__digest", "__original")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html").join(
        first,
        F.col("page_id").eqNullSafe(F.col("__page"))
        & (F.sha2(F.encode(body, "UTF-8"), 256) == F.col("__digest")),
    ).select("page_id", "url", "html", F.col("__original").alias("original"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "original")]
        for page, url, html, original in zip(*columns):
            payload = (html or "").encode("utf-8")
            own = original is None or original == page
            records = page_records(
                record_name(page, payload), url, payload, None if own else record_name(original, payload), segment
            )
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    out = map_batches(rows, run, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = out.write.option("lineSep", _END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


PAGE = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
_PARTS = (
    "record_id string, kind string, origin string, segment int, total long, refers_to string, "
    "declared string, block binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, one row each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column("content"):
            data = content.as_buffer().to_pybytes()
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            rows = []
            for fields, block in parse_records(data):
                own = fields["warc-record-id"].strip("<>")
                total = fields.get("warc-segment-total-length")
                refers = fields.get("warc-refers-to")
                rows.append(
                    (
                        own,
                        fields["warc-type"],
                        fields.get("warc-segment-origin-id", own).strip("<>"),
                        int(fields.get("warc-segment-number", 1)),
                        int(total) if total else None,
                        refers.strip("<>") if refers else None,
                        fields.get("warc-payload-digest"),
                        block,
                    )
                )
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = [part.split()[0] for part in _PARTS.split(", ")]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(files, run, _PARTS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, payload`` of every page.

    A page's segments meet by origin and are ordered by number; a missing segment, a wrong total
    length or a payload that does not match its digest is an error. Records repeated under one id are
    equal: a group keeps each segment once and their number, and gives as many rows. ``payload`` of
    a revisit is NULL.
    """
    records = read_records(spark, path)
    whole = records.groupBy("origin").agg(
        F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"),
        F.max("refers_to").alias("refers_to"),
        F.max("declared").alias("declared"),
        F.max("total").alias("total"),
        F.max("segment").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("kind") != "continuation", 1)).alias("copies"),
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = ("origin", "kind", "refers_to", "declared", "total", "last", "n", "copies", "parts")
        for start in range(0, batch.num_rows, 64):
            rows = []
            part = batch.slice(start, 64)
            for origin, kind, refers, declared, total, last, n_parts, copies, parts in zip(
                *(part.column(c).to_pylist() for c in names)
            ):
                block = b"".join(p["block"] for p in parts)
                found = [p["segment"] for p in parts]
                if kind is None or found != list(range(1, last + 1)) or n_parts != copies * last:
                    raise ValueError(f"segments of {origin} are missing or repeated")
                if last > 1 and len(block) != total:
                    raise ValueError(f"{origin} has {len(block)} bytes and declares {total}")
                head, _, body = block.partition(b"\r\n\r\n")
                page = origin.split(":")[2]
                digest = declared.removeprefix("sha1:")
                payload, refers_to = None, None
                if kind == "revisit":
                    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
                    n = int(fields[b"Content-Length"])
                    refers_to = int(refers.split(":")[2])
                else:
                    payload = dechunked(body) if b"Transfer-Encoding: chunked" in head else body
                    n = len(payload)
                    if bare_digest(payload) != digest:
                        raise ValueError(f"payload of {origin} does not match its digest")
                rows.append((int(page) if page else None, n, digest, kind, refers_to, payload, copies))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64())
            out = (*PAGE, "copies")
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, list(out))

    pages = map_batches(
        whole,
        run,
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary, copies long",
    )
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return pages.select(*PAGE, each.alias("copy")).select(*PAGE)
