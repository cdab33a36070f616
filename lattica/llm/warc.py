"""WARC archives: writing pages as records, reading them back, joining segments.

Writing: each page becomes a ``response`` record holding an HTTP message with chunked body,
or a ``revisit`` of the page with the same payload and the largest id. A block longer than
``segment_bytes`` is written as a first segment and ``continuation`` records. Archives are
gzip files of at most ``FILE_RECORDS`` records, written by Spark's text writer with the end
of a record as separator.

Reading: archives are parsed record by record. Segments are grouped by origin identifier,
ordered by segment number, checked against the total length, joined, and the chunked
transfer framing is decoded; digests are verified. Revisits take length and page id from the
record that they refer to.

Defined cases: a null payload is empty; a null page id never is the target of a revisit
while its group has another; repeated rows (same id and payload) are written and read as
often as they occur; empty input gives no rows; a record that fails a check raises.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_RECORDS = 20_000
SALTS = 16
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(framed[at : at + size])
        at += size + 2


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def records_of(page_id, url, body: bytes, winner, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page, without the separator that ends each."""
    digest = digest32(body)
    own = record_id("page", page_id, digest)
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-Id", page_id)]
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", profile), ("WARC-Refers-To", record_id("page", winner, digest))], b"")
        return
    block = _HTTP + chunked(body)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")], block)
        return
    count = -(-len(block) // segment_bytes)
    for k in range(count):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        if k == 0:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("Content-Type", "application/http;msgtype=response")]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id("part", own, k)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own)]
        fields.append(("WARC-Segment-Number", k + 1))
        if k == count - 1:
            fields.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(fields, part)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as gzip WARC files under ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("body"))
    sha = F.sha1("body")
    winners = rows.where(F.length("body") >= min_revisit_bytes).groupBy(sha.alias("sha")).agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("m")).where("m > 1 and winner is not null")
    # A payload may be that of a third of all pages: its rows are dealt over SALTS partitions.
    winners = winners.select("sha", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("sha", sha).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(winners, ["sha", "salt"], "left")
    rows = rows.select("page_id", "url", "body", "winner", (F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id"))).alias("revisit"))

    def write(batches):
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                page_id, url, body, winner, revisit = (batch.column(c)[i].as_py() for c in range(5))
                for record in records_of(page_id, url, body, winner, revisit, segment_bytes):
                    out.append(record)
                    size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    written = map_batches(rows, write, "record binary").select(F.col("record").cast("string"))
    written.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, gzip (one member or many) or plain."""
    zipped = archive[:2] == b"\x1f\x8b"
    view, at, buf = memoryview(archive), 0, bytearray()
    unzip = zlib.decompressobj(31) if zipped else None

    def more() -> bool:
        nonlocal at, unzip
        while at < len(view):
            piece = view[at : at + (1 << 18)]
            at += len(piece)
            if not zipped:
                buf.extend(piece)
                return True
            got = unzip.decompress(piece)
            if unzip.eof:
                at -= len(unzip.unused_data)
                unzip = zlib.decompressobj(31)
            if got:
                buf.extend(got)
                return True
        return False

    start = 0
    while True:
        while (end := buf.find(_END, start)) < 0:
            if not more():
                if bytes(buf[start:]).strip():
                    raise ValueError("truncated record header")
                return
        lines = bytes(buf[start:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        begin, length = end + 4, int(head["Content-Length"])
        while len(buf) < begin + length + 4:
            if not more():
                raise ValueError("truncated record block")
        if buf[begin + length : begin + length + 4] != _END:
            raise ValueError("record without its end")
        yield head, bytes(buf[begin : begin + length])
        start = begin + length + 4
        if start > 1 << 20:
            del buf[:start]
            start = 0


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(_END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_FIELDS = ["record_id", "page_id", "type", "refers_to", "origin", "segment", "total", "payload_bytes", "digest", "block"]
_SCHEMA = "record_id string, page_id long, type string, refers_to string, origin string, segment int, total long, payload_bytes long, digest string, block binary"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _checked(block: bytes, digest: str | None) -> tuple[int, str]:
    payload = payload_of(block)
    got = digest32(payload)
    if digest is not None and got != digest:
        raise ValueError("payload digest differs")
    return len(payload), got


def _parsed(batches):
    for batch in batches:
        for archive in batch.column("content"):
            rows, size = [], 0
            for head, block in parse(archive.as_py()):
                page, segment = head.get("Page-Id"), head.get("WARC-Segment-Number")
                digest = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                kind, n = head["WARC-Type"], None
                if kind == "response" and segment is None:
                    n, digest = _checked(block, digest)
                origin = head.get("WARC-Segment-Origin-ID") or (head["WARC-Record-ID"] if segment else None)
                total = head.get("WARC-Segment-Total-Length")
                rows.append((head["WARC-Record-ID"], None if page is None else int(page), kind, head.get("WARC-Refers-To"), origin, segment and int(segment), total and int(total), n, digest, block if segment else None))
                size += len(block) if segment else 0
                if len(rows) >= 4096 or size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_FIELDS)


def _joined(batches):
    """Whole records from their segments: ordered, complete, of the stated length; as many as there are copies."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            parts = batch.column("parts")[i].as_py()
            by_number: dict[int, list] = {}
            for p in parts:
                by_number.setdefault(p["segment"], []).append(p)
            numbers = sorted(by_number)
            copies = {len(x) for x in by_number.values()}
            if numbers != list(range(1, len(numbers) + 1)) or len(copies) != 1:
                raise ValueError("missing segment")
            block = b"".join(by_number[k][0]["block"] for k in numbers)
            if by_number[numbers[-1]][0]["total"] != len(block):
                raise ValueError("total length differs")
            head = by_number[1][0]
            n, digest = _checked(block, head["digest"])
            rows += [(head["record_id"], head["page_id"], "response", None, None, None, None, n, digest, None)] * copies.pop()
        yield _batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each archived page."""
    records = map_batches(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content"), _parsed, _SCHEMA)
    # The number of segments of one record is bounded by its own length.
    parts = records.where("segment is not null").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "record_id", "page_id", "digest", "block")).alias("parts"))
    whole = records.where("segment is null and type = 'response'").union(map_batches(parts, _joined, _SCHEMA)).select("record_id", "page_id", "payload_bytes", "digest")
    revisits = records.where("type = 'revisit'").select("page_id", "refers_to", "digest")
    targets = whole.join(revisits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi").dropDuplicates(["record_id"])
    targets = targets.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("target"), "payload_bytes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = salted.join(targets, ["refers_to", "salt"], "left").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("target").alias("refers_to"))
    again = again.withColumn("payload_bytes", F.coalesce("payload_bytes", F.raise_error(F.lit("a revisit's target is missing")).cast("long")))
    return whole.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(again)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
