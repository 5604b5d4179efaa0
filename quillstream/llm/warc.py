"""WARC archives: a writer with identical-payload revisits, and a salvage reader.

The writer puts a gzip member a record into files that roll at ``roll`` bytes. Of
records with equal payloads of at least ``least`` bytes, that with the largest
page_id is a response; the others are revisits that name it and leave the payload
out. Which payloads are shared is a count by digest, combined map-side; only the
shared digests are joined back, broadcast where they are few.

The reader takes each file from its start and checks every record: gzip checks,
version line, header lines, content length, closing lines and payload digest.
Where a check fails, it looks from the next byte on for the next gzip member or
version line whose record passes, goes on there, and reports the bytes in between
as a quarantined gap with the reason of the first failure. Inside a gzip member of
several records it does the same with the unpacked bytes, and reports such a gap by
its place there. Of a member that breaks off, those records stay whose digests
hold. Headers and records may be of any length; one record is held at a time.

A null html is an empty payload, a null url leaves the target out. Pages without
page_id are responses of their own. Repeated rows of the largest page_id are all
responses. An empty table gives no archive and an empty result. Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, by_bytes, materialise, scratch_path

#: Digests up to which the shared ones are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_NAME = re.compile(rb"<urn:quillstream:page:(-?\d+)>")


def _uri(page_id: int | None) -> str:
    return f"<urn:quillstream:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to`` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_warc(pages: DataFrame, folder: str, least: int = 1000, roll: int = 64 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in ``folder``; returns the files (name, bytes, records)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    shared = rows.filter(f"size >= {int(least)} and page_id is not null").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = materialise(shared, "shared")
    few = shared.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(shared) if few else shared, "digest", "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    rows = rows.withColumn("refers", refers).select("page_id", "url", F.when(F.col("refers").isNull(), F.col("html")).alias("html"), "size", "digest", "refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, task = SharedFiles(folder), TaskContext.get()
        out, done, name, size, n = None, [], "", 0, 0
        for batch in by_bytes(batches, "html"):
            for row in batch.to_pylist():
                member = gzip_member(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["size"], row["digest"], row["refers"]))
                if out is not None and size + len(member) > roll:
                    out.close()
                    done.append((name, size, n))
                    out = None
                if out is None:
                    name, size, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz", 0, 0
                    out = files.create(name)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            done.append((name, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["name", "bytes", "records"])

    return materialise(rows.mapInArrow(write, "name string, bytes long, records long"), "archives")


class Broken(ValueError):
    """A record that fails a check."""


#: Bytes read at a time.
READ = 1 << 16
_START = re.compile(rb"WARC/1\.\d\r\n")


class _Bytes:
    """Bytes of an archive or of a gzip member, read piece by piece and forgotten behind ``at``."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.base, self.at = pieces, bytearray(), 0, 0

    def more(self) -> bool:
        piece = next(self.pieces, b"")
        if self.at - self.base > 1 << 20:
            del self.held[: self.at - self.base]
            self.base = self.at
        self.held += piece
        return bool(piece)

    def upto(self, end: int) -> bool:
        """Are the bytes up to place ``end`` there?"""
        while self.base + len(self.held) < end:
            if not self.more():
                return False
        return True

    def find(self, what: bytes, start: int) -> int:
        """The first place of ``what`` from ``start`` on, or -1."""
        while (found := self.held.find(what, start - self.base)) < 0:
            start = max(start, self.base + len(self.held) - len(what) + 1)
            if not self.more():
                return -1
        return self.base + found

    def get(self, start: int, end: int) -> bytes:
        return bytes(self.held[start - self.base : end - self.base])

    def next_version(self) -> bool:
        """Goes to the next version line behind the present place; False at the end."""
        self.at += 1
        while not (found := _START.search(self.held, self.at - self.base)):
            self.at = max(self.at, self.base + len(self.held) - 9)
            if not self.more():
                self.at = self.base + len(self.held)
                return False
        self.at = self.base + found.start()
        return True


def parse(data: _Bytes, sure: bool = False) -> tuple[dict, bytes]:
    """(headers, block) of the record at ``data.at``, which moves behind it; Broken if it fails a check, or, if ``sure``, has no digest to check."""
    at = data.at
    data.upto(at + 10)
    if not _START.match(data.get(at, at + 10)):
        raise Broken("version line")
    close = data.find(b"\r\n\r\n", at)
    if close < 0:
        raise Broken("header end")
    headers = {}
    for line in data.get(at, close).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Broken("header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip()
    length = headers.get("content-length", b"")
    if not length.isdigit():
        raise Broken("content length")
    start, end = close + 4, close + 4 + int(length)
    if not data.upto(end + 4) or data.get(end, end + 4) != b"\r\n\r\n":
        raise Broken("record end")
    block = data.get(start, end)
    told = headers.get("warc-payload-digest", b"")
    if told.startswith(b"sha1:") and headers.get("warc-type") == b"response":
        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", b"").startswith(b"application/http") else block
        if base64.b32encode(hashlib.sha1(payload).digest()) != told[5:]:
            raise Broken("payload digest")
    elif sure:
        raise Broken("no digest")
    data.at = end + 4
    return headers, block


class _Member:
    """The unpacked pieces of the gzip member at ``at``; afterwards its end, or what it broke at."""

    def __init__(self, source, at: int):
        self.source, self.at, self.end, self.reason = source, at, None, None

    def __iter__(self) -> Iterator[bytes]:
        unpack, place = zlib.decompressobj(31), self.at
        while not unpack.eof:
            self.source.seek(place)
            raw = self.source.read(READ)
            if not raw:
                self.reason = "gzip member cut off"
                return
            place += len(raw)
            before = unpack.copy()
            try:
                out = unpack.decompress(raw)
            except zlib.error as e:
                self.reason = "gzip " + str(e).rpartition(": ")[2]
                for i in range(len(raw)):  # what comes before the break
                    try:
                        if out := before.decompress(raw[i : i + 1]):
                            yield out
                    except zlib.error:
                        return
            if out:
                yield out
        self.end = place - len(unpack.unused_data)


def _next_start(source, at: int, size: int) -> int:
    """Where from ``at`` on the next gzip member or version line starts."""
    while at < size:
        source.seek(at)
        raw = source.read(READ)
        found = re.search(rb"\x1f\x8b\x08|WARC/1\.\d\r\n", raw)
        if found:
            return at + found.start()
        at += max(1, len(raw) - 16) if at + len(raw) < size else size
    return size


def _in_member(source, at: int) -> Iterator[tuple]:
    """Of the gzip member at ``at``, as ``salvage``; at last (end, or None; reason)."""
    member = _Member(source, at)
    data, bad, reason, held, n = _Bytes(iter(member)), None, None, None, 0
    while data.upto(data.at + 1):
        place = data.at
        try:
            headers, block = parse(data, member.reason is not None)
        except Broken as e:
            bad, reason = (place, str(e)) if bad is None else (bad, reason)
            data.next_version()
            continue
        if bad is not None:
            yield at, None, bad, place - bad, None, b"", reason
            bad = None
        if held:
            yield held
        held, n = (at, None, place, data.at - place, headers, block, None), n + 1
    whole = None if member.end is None else member.end - at
    if held:
        yield held if n > 1 or bad is not None or whole is None else (at, whole, *held[2:])
    if whole is not None and (bad is not None or not n):
        yield (at, whole, None, None, None, b"", reason or "empty member") if not n else (at, None, bad, data.at - bad, None, b"", reason)
    yield member.end, member.reason


def salvage(source, size: int) -> Iterator[tuple]:
    """Of an open file (offset, bytes, inner offset, inner bytes, headers, block, None) of each sound record, and without headers, with a reason, of each gap.

    The inner places are those in the unpacked bytes of a gzip member, of which bytes is null where it holds more than the record.
    """
    at, bad, reason = 0, None, ""

    def pieces(place: int) -> Iterator[bytes]:
        while place < size:
            source.seek(place)
            raw = source.read(READ)
            if not raw:
                return
            place += len(raw)
            yield raw

    while at < size:
        source.seek(at)
        packed = source.read(3) == b"\x1f\x8b\x08"
        end, why = None, None
        if packed:
            rows = _in_member(source, at)
            for row in rows:
                if len(row) == 2:
                    end, why = row
                    break
                if bad is not None:
                    yield bad, at - bad, None, None, None, b"", reason
                    bad = None
                yield row
        else:
            data = _Bytes(pieces(at))
            try:
                while data.upto(data.at + 1) and not data.get(data.at, data.at + 3) == b"\x1f\x8b\x08":
                    place = data.at
                    headers, block = parse(data)
                    if bad is not None:
                        yield bad, at + place - bad, None, None, None, b"", reason
                        bad = None
                    yield at + place, data.at - place, None, None, headers, block, None
            except Broken as e:
                why = str(e)
                at += data.at
            else:
                end = at + data.at
        if end is None:
            bad, reason = (at, why) if bad is None else (bad, reason)
            at = _next_start(source, at + 1, size)
        else:
            at = end
    if bad is not None:
        yield bad, size - bad, None, None, None, b"", reason


RECORDS = (
    "name string, offset long, bytes long, inner_offset long, inner_bytes long, gap_reason string, record_type string, page_id long, refers_to long, url string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read_warc(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives (name) in ``folder``, as RECORDS; a gap has a gap_reason and no record_type.

    A revisit's payload_bytes and payload_digest are those of the full payload, which it does not hold.
    """
    columns = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = SharedFiles(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with shared.open(name) as source:
                    for offset, size, place, length, headers, block, reason in salvage(source, source.size()):
                        if headers is None:
                            rows.append((name, offset, size, place, length, reason, *[None] * 7))
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        ids = [_NAME.match(headers.get(h, b"")) for h in ("warc-record-id", "warc-refers-to")]
                        told = re.search(rb"(?i)content-length:\s*(\d+)", http)
                        digest = headers.get("warc-payload-digest", b"")[5:]
                        url = headers.get("warc-target-uri")
                        rows.append((
                            name, offset, size, place, length, None, headers.get("warc-type", b"").decode(), *(int(x[1]) if x else None for x in ids), url.decode() if url is not None else None,
                            int(told[1]) if told else len(payload), base64.b32decode(digest).hex() if len(digest) == 32 else None, payload if payloads else None,
                        ))
                        held += len(payload) if payloads else 100
                        if held > 4 << 20 or len(rows) > 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], columns)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], columns)

    spread = files.select("name").repartition(max(1, min(10_000, files.count())), "name")
    return spread.mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    folder = scratch_path(pages.sparkSession, "warc")
    files = write_warc(pages, folder, least)
    rows = read_warc(files, folder, payloads=False).filter("gap_reason is null")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
