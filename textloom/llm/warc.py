"""WARC records: reading, segmentation and reassembly of continuation records."""

from __future__ import annotations

import io
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import quoted, whole

RECORDS = "record_id string, warc_type string, origin_id string, segment_number int, total_length bigint, target_uri string, block binary"
NAMES = [x.split()[0] for x in RECORDS.split(", ")]
WHOLE = "record_id string, target_uri string, segments int, length bigint, status string, http_status int, body binary"


DAMAGED = "damaged"  # the type of a record that can't be read


class Message(NamedTuple):
    status: int | None
    headers: dict[str, str]
    body: bytes


class FramingError(ValueError):
    """Chunked transfer framing that doesn't decode."""


def dechunked(data: bytes) -> bytes:
    """The content of a chunked body; extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise FramingError("no chunk size")
        size = data[at:end].split(b";", 1)[0].strip()
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size):
            raise FramingError("bad chunk size")
        n = int(size, 16)
        at = end + 2
        if n == 0:
            break
        if data[at + n : at + n + 2] != b"\r\n" or at + n + 2 > len(data):
            raise FramingError("chunk is cut off")
        out.append(data[at : at + n])
        at += n + 2
    while True:  # trailers, then an empty line
        end = data.find(b"\r\n", at)
        if end < 0:
            raise FramingError("no end of trailers")
        if end == at:
            if end + 2 != len(data):
                raise FramingError("bytes after the last chunk")
            return b"".join(out)
        at = end + 2


def chunked(body: bytes, size: int) -> bytes:
    """body in chunks of size bytes."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def message(block: bytes) -> Message:
    """An HTTP response with its transfer framing decoded; without a status line, the block as it is."""
    if not block.startswith(b"HTTP/"):
        return Message(None, {}, block)
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise FramingError("no end of headers")
    first, *lines = block[:end].split(b"\r\n")
    headers: dict[str, str] = {}
    for line in lines:
        name, _, value = line.decode("latin-1").partition(":")
        headers[name.strip().lower()] = value.strip()
    body = block[end + 4 :]
    codings = [c.strip().lower() for c in headers.get("transfer-encoding", "").split(",")]
    if "chunked" in codings:
        body = dechunked(body)
    status = first.split()[1:2]
    return Message(int(status[0]) if status and status[0].isdigit() else None, headers, body)


def assembled(origin: str, parts: list[dict]) -> dict:
    """The whole record of the parts of one origin; status says what is wrong with it.

    ok; bad_record (one whose headers or block can't be read); no_first (segment 1 is missing); bad_number (a continuation without a
    number above 1); conflict (two different segments of one number);
    missing_segment (a gap, or a segment without content); unterminated (the
    last segment states no total length); length_mismatch; bad_framing.
    """
    by: dict[int, dict] = {}
    status = "ok"
    for p in parts:
        number = p["segment_number"]
        if p["warc_type"] == DAMAGED:
            status = "bad_record"
            continue
        if number is None and p["warc_type"] != "continuation":
            number = 1
        if number is None or number < 1 or (p["warc_type"] == "continuation") != (number > 1):
            status = "bad_number" if status == "ok" else status
            continue
        if status == "ok" and number in by and (by[number]["block"] != p["block"] or by[number]["total_length"] != p["total_length"]):
            status = "conflict"
        by.setdefault(number, p)
    numbers = sorted(by)
    first = by.get(1)
    data = b"".join(by[n]["block"] or b"" for n in numbers)
    if status == "ok":
        if first is None:
            status = "no_first"
        elif numbers[-1] != len(numbers) or any(by[n]["block"] is None for n in numbers):
            status = "missing_segment"
        else:
            total = by[numbers[-1]]["total_length"]
            segmented = len(numbers) > 1 or first["segment_number"] is not None
            if total is None and segmented:
                status = "unterminated"
            elif total is not None and total != len(data):
                status = "length_mismatch"
    got = None
    if status == "ok":
        try:
            got = message(data)
        except FramingError:
            status = "bad_framing"
    return {
        "record_id": origin,
        "target_uri": first["target_uri"] if first else None,
        "segments": len(numbers),
        "length": len(data),
        "status": status,
        "http_status": got.status if got else None,
        "body": got.body if got else None,
    }


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, target_uri, segments, length, status, http_status, body), one row per origin.

    Records are brought together by the identifier of their origin (a first
    segment's own identifier), ordered by segment number within the partition
    and joined in one pass, so that a task holds one whole record at a time.

    The columns of RECORDS are read, others ignored; block may be null.  A
    record without any identifier gives a row of its own with status no_id.
    Repeated equal segments count once; see assembled() for what else a status
    says.  body is null unless the status is ok.  Empty table: no rows.
    """
    rows = records.select(*[quoted(c) for c in NAMES]).withColumn("origin", F.coalesce(F.when(F.col("warc_type") == "continuation", F.col("origin_id")), F.when(F.coalesce(F.col("warc_type"), F.lit("")) != "continuation", F.col("record_id"))))
    schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("segments", pa.int32()), ("length", pa.int64()), ("status", pa.string()), ("http_status", pa.int32()), ("body", pa.binary())])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, held, out, size = None, [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                own = r.pop("origin")
                if own is None:
                    out.append({"record_id": None, "target_uri": r["target_uri"], "segments": 1, "length": len(r["block"] or b""), "status": "bad_record" if r["warc_type"] == DAMAGED else "no_id", "http_status": None, "body": None})
                    continue
                if own != origin:
                    if held:
                        out.append(assembled(origin, held))
                        size += len(out[-1]["body"] or b"")
                    origin, held = own, []
                held.append(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if held:
            out.append(assembled(origin, held))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    # records without an identifier are spread out: they don't meet
    spread = F.coalesce(F.col("origin"), F.concat(F.lit("\0"), F.xxhash64("target_uri", "block").cast("string")))
    return rows.withColumn("spread", spread).repartition("spread").sortWithinPartitions("spread", "origin", "segment_number").drop("spread").mapInArrow(join, WHOLE)


def segmented(df: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", segment_bytes: int = 2048, chunk_bytes: int = 1500) -> DataFrame:
    """Rows as HTTP response records with chunked bodies, cut into segments of at most segment_bytes.

    Rows without a body are left out, an empty body is a record.  The record of
    a row with id x is ``urn:page:x:n``, ``urn:page::n`` for a null id, n being
    a number of the row, so that repeated ids and repeated rows each give a
    record of their own.  Very long bodies give as many segments as they need.
    A null uri is kept.  Empty table: no records.  Other columns are ignored.
    """
    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("origin_id", pa.string()), ("segment_number", pa.int32()), ("total_length", pa.int64()), ("target_uri", pa.string()), ("block", pa.binary())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches, 8 << 20):
            cols: list[list] = [[] for _ in range(7)]
            for name, number, uri, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body.encode(), chunk_bytes)
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                origin = f"urn:page:{'' if name is None else name}:{number}"
                last = len(parts)
                for k, part in enumerate(parts, 1):
                    row = (origin if k == 1 else f"{origin}#{k}", "response" if k == 1 else "continuation", None if k == 1 else origin, k, len(block) if k == last else None, uri if k == 1 else None, part)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    rows = df.select(quoted(id_col).cast("string").alias("id"), F.monotonically_increasing_id().alias("number"), quoted(uri_col).cast("string").alias("uri"), quoted(body_col).cast("string").alias("body"))
    return rows.where("body is not null").mapInArrow(cut, RECORDS)


class Inflated(io.RawIOBase):
    """The content of gzip members one after the other; what comes before a break is given, then broken is set."""

    def __init__(self, source: BinaryIO):
        self.source, self.member, self.rest, self.broken = source, None, b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.broken:
            data = self.rest or self.source.read(1 << 16)
            self.rest = b""
            if not data:
                self.broken = self.member is not None
                break
            try:
                self.member = self.member or zlib.decompressobj(31)
                out = self.member.decompress(data, len(target))
                self.rest = self.member.unconsumed_tail or self.member.unused_data
                if self.member.eof:
                    self.member = None
            except zlib.error:
                self.broken = True
                break
            if out:
                target[: len(out)] = out
                return len(out)
        return 0


def parsed(source: bytes | BinaryIO) -> Iterator[dict]:
    """The records of a WARC file, plain or compressed record by record, read one at a time.

    What can't be read gives a record of type ``damaged`` with a null block: one
    without a usable length or segment number, one that is cut off, bytes that
    are no record, the place where compression breaks.  Reading goes on at the
    next line that begins a record, except after broken compression.
    """
    source = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source)  # type: ignore[arg-type]
    if source.peek(2)[:2] != b"\x1f\x8b":
        yield from _records(source)
        return
    inflated = Inflated(source)
    last = None
    for last in _records(io.BufferedReader(inflated)):
        yield last
    if inflated.broken and (last is None or last["warc_type"] != DAMAGED):
        yield dict(BAD)


BAD = dict.fromkeys(NAMES) | {"warc_type": DAMAGED}


def _records(source: io.BufferedReader) -> Iterator[dict]:
    line = source.readline()
    while line:
        if not line.strip():
            line = source.readline()
            continue
        if not line.startswith(b"WARC/"):
            yield dict(BAD)
            while line and not line.startswith(b"WARC/"):
                line = source.readline()
            continue
        head: dict[str, str] = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size, number, total = (head.get(k) for k in ("content-length", "warc-segment-number", "warc-segment-total-length"))
        record = {
            "record_id": head.get("warc-record-id"),
            "warc_type": head.get("warc-type"),
            "origin_id": head.get("warc-segment-origin-id"),
            "segment_number": None,
            "total_length": None,
            "target_uri": head.get("warc-target-uri"),
            "block": None,
        }
        if not _number(size, 1 << 62) or not _number(number or "1", 1 << 31) or not _number(total or "0", 1 << 62):
            yield record | {"record_id": record["origin_id"] or record["record_id"], "warc_type": DAMAGED}
            while (line := source.readline()) and not line.startswith(b"WARC/"):
                pass
            continue
        block = source.read(int(size))
        if len(block) < int(size):
            yield record | {"record_id": record["origin_id"] or record["record_id"], "warc_type": DAMAGED}
            return
        yield record | {"segment_number": int(number) if number else None, "total_length": int(total) if total else None, "block": block}
        line = source.readline()


def _number(text: str | None, limit: int) -> bool:
    return text is not None and text.isascii() and text.isdigit() and int(text) < limit


def formatted(record: dict) -> bytes:
    """A record of RECORDS in WARC form."""
    fields = [
        ("WARC-Type", record["warc_type"]),
        ("WARC-Record-ID", record["record_id"]),
        ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Segment-Number", record["segment_number"]),
        ("WARC-Segment-Origin-ID", record["origin_id"]),
        ("WARC-Segment-Total-Length", record["total_length"]),
        ("Content-Length", len(record["block"])),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + record["block"] + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under a path, one task per file or group of files.

    Workers open the files themselves and stream them, so that a file may be
    larger than memory; what can't be read gives damaged records, see parsed().
    An empty file gives no records.
    """
    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("origin_id", pa.string()), ("segment_number", pa.int32()), ("total_length", pa.int64()), ("target_uri", pa.string()), ("block", pa.binary())])

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for name in (x.as_py() for batch in batches for x in batch.column(0)):
            scheme, _, rest = name.partition(":")
            place = "file://" + urllib.parse.unquote(rest.removeprefix("//")) if scheme == "file" else name.replace("s3a:", "s3:", 1)
            store, file = (pa.fs.LocalFileSystem(), place.removeprefix("file://")) if scheme == "file" else pa.fs.FileSystem.from_uri(place)
            with store.open_input_stream(file, compression=None) as source:
                held, size = [], 0
                for r in parsed(source):
                    held.append(r)
                    size += len(r["block"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = max(1, files.count())
    return files.select("path").repartition(min(parts, 4 * spark.sparkContext.defaultParallelism), "path").mapInArrow(parse, RECORDS)
