"""WARC archives of web pages: segmented, chunked records out, reassembled and decoded records in.

Each page is a record whose block is an HTTP response in chunked transfer framing. A block longer
than ``segment_bytes`` is cut into a first record and continuation records. Of equal payloads of at
least ``revisit_bytes``, the page with the smallest identifier is the response and the others
revisit it. Reading groups segments by origin identifier, orders them by number, verifies that none
is missing and that the length is the total that the last one states, and decodes the framing.
Each record is a gzip member of its own, so that readers can go to any record.

Null payload is an empty one. A null identifier comes after all others. Rows repeated with the
identifier of a response are all responses. Null addresses have no header; control characters in
addresses are percent-encoded. Segments that don't make up their record, framing that doesn't
decode, headers without what a record needs, and members that end early or hold anything but one
record give ``intact`` false and no payload; what can't be told of such a record is null. Reading
goes on with the next member, or, where the compressed data itself is damaged, with the next file.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scratch, staged

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
_ROW_BYTES = 1 << 20
_STEP = 8 << 10
#: Rows of the sink, of about a compressed megabyte, that one archive file holds.
ROWS_PER_FILE = 8
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_HEX = re.compile(rb"[0-9A-Fa-f]+")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload; ``ValueError`` where a chunk's size or end isn't what it has to be."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip()
        if not _HEX.fullmatch(digits):
            raise ValueError("a chunk has no size")
        size = int(digits, 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk doesn't end where it says")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    """Header fields under their lower-cased names; a line that begins with a blank continues the one before."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif ":" in line:
            lines.append(line)
    return {name.strip().lower(): value.strip() for name, value in (line.split(":", 1) for line in lines)}


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that follow each other in ``raw``; ``ValueError`` where that isn't so."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if raw[at : at + 5] != b"WARC/" or end < 0:
            raise ValueError("a record doesn't begin where the one before it ends")
        fields = header_fields(raw[at:end])
        begin, size = end + 4, fields.get("content-length", "")
        if not size.isdecimal() or raw[begin + int(size) : begin + int(size) + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it says")
        yield fields, raw[begin : begin + int(size)]
        at = begin + int(size) + 4


def page_records(page, url: str | None, payload: bytes, first, first_url: str | None, date: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page; ``first`` is the identifier of the page that it revisits, if any."""
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    safe = lambda u: None if u is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", u)
    common = [("WARC-Date", date), ("WARC-Target-URI", safe(url)), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("X-Page-ID", page), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        revisit = [("WARC-Type", "revisit"), ("WARC-Record-ID", name()), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", safe(first_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", first)]
        yield record(revisit + common, _HEAD)
        return
    block, origin = _HEAD + chunked(payload), name()
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", origin), ("WARC-Segment-Number", 1), *common], parts[0])
    for number, part in enumerate(parts[1:], 2):
        total = len(block) if number == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name()), ("WARC-Date", date), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], part)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Gzipped archives under ``folder``, written by Spark's own sink, which all file systems take.

    Records are far below 16 MiB, so the last byte of a gzip member, the top byte of its length, is zero.
    That zero is the sink's line separator, and a row holds members without the last one's end.
    """
    if segment_bytes > 8 << 20:
        raise ValueError("segments are at most 8 MiB")

    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    order = F.struct(F.col("page").isNull().alias("none"), "page", "url")
    groups = base.filter(F.length("payload") >= revisit_bytes).groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = staged(groups.select("sha", F.col("first.page").alias("first"), F.col("first.url").alias("first_url")), "warc-groups")
    marked = base.join(groups, "sha", "left")
    revisits = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    marked = marked.select("page", "url", "payload", F.when(revisits, F.col("first")).alias("first"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page, url, payload, first, first_url in zip(*(batch.column(i) for i in range(5))):
                for made in page_records(page.as_py(), url.as_py(), payload.as_py(), first.as_py(), first_url.as_py(), date, segment_bytes):
                    held.append(zlib_member(made))
                    size += len(held[-1])
                    if size >= _ROW_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["records"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["records"])

    lines = marked.mapInArrow(run, "records binary").select(F.col("records").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", ROWS_PER_FILE).text(folder)


def zlib_member(raw: bytes) -> bytes:
    """``raw`` as a gzip member without time or name."""
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(raw) + packed.flush()


def members(raw: bytes) -> Iterator[bytes | None]:
    """What each gzip member holds; None for one that ends early or is damaged, which ends the file."""
    view, at = memoryview(raw), 0
    while at < len(view):
        member, found = zlib.decompressobj(31), []
        try:
            while not member.eof and at < len(view):
                # In steps, since what follows a member is copied.
                piece = view[at : at + _STEP]
                found.append(member.decompress(piece))
                at += len(piece) - len(member.unused_data)
        except zlib.error:
            yield None
            return
        yield b"".join(found) if member.eof else None


_FIELDS = [("page", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
_COLUMNS = "page long, url string, kind string, digest string, refers_to long, origin string, segment int, total long, block binary"


def _number(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name)
    return int(value) if value and value.lstrip("-").isdecimal() else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
    return (
        _number(fields, "x-page-id"), fields.get("warc-target-uri"), fields.get("warc-type"), fields.get("warc-payload-digest", "")[5:] or None, _number(fields, "x-refers-to-page-id"),
        origin, _number(fields, "warc-segment-number"), _number(fields, "warc-segment-total-length"), block,
    )


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record; of what isn't one, a row of nulls."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def rows(content: bytes) -> Iterator[tuple]:
        for member in members(content):
            try:
                found = [_row(fields, block) for fields, block in records(member)] if member is not None else []
            except ValueError:
                found = []
            yield from found or [(None,) * len(_FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_FIELDS)
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return files.mapInArrow(run, _COLUMNS)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, intact) per record.

    Of responses the digest is computed from the payload; a revisit has no payload, and the digest
    that its header states.
    """
    parsed = staged(_parsed(spark, folder), "warc-parsed")
    whole = parsed.filter("segment IS NULL").select("page", "url", "kind", "digest", "refers_to", F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("parts"), F.length("block").cast("long").alias("total"))
    cut = parsed.filter("segment IS NOT NULL").groupBy("origin").agg(
        F.max("page").alias("page"), F.max("url").alias("url"), F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"), F.max("digest").alias("digest"), F.max("refers_to").alias("refers_to"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
    ).drop("origin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, digests, intact = [], [], []
            for kind, digest, parts, total in zip(*(batch.column(i) for i in (2, 3, 5, 6))):
                parts = parts.as_py()
                block = b"".join(p["block"] or b"" for p in parts)
                good = len(block) == total.as_py() and [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and kind.as_py() is not None
                payload = None
                if good and kind.as_py() == "response":
                    try:
                        payload = http_payload(block)
                    except ValueError:
                        good = False
                payloads.append(payload)
                digests.append(digest.as_py() if payload is None else digest32(payload))
                intact.append(good and digests[-1] == digest.as_py())
            sizes = [None if p is None else len(p) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column(4), pa.array(intact, pa.bool_())], names=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "intact"])

    return whole.unionByName(cut).mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, intact boolean")


def page_round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder, reads them back, and gives revisits their payload's size."""
    spark, folder = pages.sparkSession, scratch(pages.sparkSession, "warc")
    write_archives(pages, folder)
    read = staged(read_archives(spark, folder).drop("payload"), "warc-records")
    known = read.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("known_bytes"))
    known = staged(known.join(read.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi"), "warc-known")
    size = F.coalesce("payload_bytes", "known_bytes")
    return read.join(known, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", size).drop("known_bytes")
