"""Legacy archive converter: ARC version 1 and 2 files to WARC records.

``parse_arc`` reads the version block, takes the field names of the record lines
from it, and cuts bodies by their declared lengths. ``warc_record`` synthesises
what ARC lacks: record identifiers (name-based UUIDs), ISO timestamps, record
types and SHA-1 digests. ``read_arc_files`` is a source of ARC folders, plain or
gzip-compressed, and ``convert_arc_files`` turns them into WARC archives.

An archive holds a gzip member for each record, so every record can be reached by its
offset, and is closed at ``ARCHIVE_BYTES``; a task holds one archive. Spark's text
writer writes one archive a file: the last byte of a gzip member is the high byte of a
length, 0 under 16 MB, and that 0 is the writer's line separator. Archives are read
back record by record, and digests are verified on reading.

Of equal payloads of at least ``REVISIT_BYTES`` bytes the row with the largest id
is a response and the others become revisits of it; rows that share the largest
id are all responses, so repeated rows are. Null payloads are empty; null URLs get a
URN; a null id counts as the smallest and stays null. Identifiers may be of any type
that can be ordered and cast to text and back. Spaces and control characters of URLs
are percent-encoded. An empty table gives archives without records. Only the named
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import exchanged, scratch_path

REVISIT_BYTES = 1000
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Records of a table that make one ARC file in memory on their way to WARC.
ARC_BATCH = 256
# Fixed values of the ARC file format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
CRLF = b"\r\n"
GAP = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes
    truncated: bool = False

    @property
    def url(self) -> str:
        return self.fields.get("URL", "")


def encode_url(url: str | None, ident) -> str:
    if url is None or url == "":
        return f"urn:page:{ident}"
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass")


def arc_version_block(version: int, name: str = "pages.arc", date: str = "20200101000000", origin: str = "archive") -> bytes:
    rest = f"{version} 0 {origin}\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(rest))]
    return " ".join(head).encode() + b"\n" + rest + b"\n"


def arc_record(version: int, url: str, body: bytes, date: str = "20200101000000", ip: str = "0.0.0.0", kind: str = "text/html", name: str = "pages.arc") -> bytes:
    head = [url, ip, date, kind, *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return " ".join(head).encode("utf-8", "surrogatepass") + b"\n" + body + b"\n"


class _Chunks(io.RawIOBase):
    """A stream over chunks of bytes."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.rest = chunks, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            part = next(self.chunks, None)
            if part is None:
                return 0
            self.rest = part
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def parse_arc(data: bytes | BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first; memory is one record. A body
    shorter than its declared length is marked truncated; a malformed record line
    raises."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    version, names = 0, ARC_FIELDS[1]
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8", "surrogatepass").split(" ")
        if not version:  # the version line has version 1's or 2's field count
            names = ARC_FIELDS[2] if len(parts) == len(ARC_FIELDS[2]) else ARC_FIELDS[1]
        if len(parts) > len(names):  # an unencoded blank in the content type
            at = names.index("Content-type")
            extra = len(parts) - len(names)
            parts[at : at + extra + 1] = [" ".join(parts[at : at + extra + 1])]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"malformed ARC record line: {line[:80]!r}")
        fields = dict(zip(names, parts, strict=True))
        length = int(fields["Archive-length"])
        body = stream.read(length)
        if not version:
            lines = body.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            if len(lines) > 1 and lines[1].startswith("URL "):
                names = lines[1].strip().split(" ")
            elif version in ARC_FIELDS:
                names = ARC_FIELDS[version]
        yield ArcRecord(version, fields, body, len(body) < length)


def warc_date(arc_date: str) -> str:
    """ISO timestamp of a 14- or 12-digit ARC date; missing digits are zero."""
    d = re.sub(r"\D", "", arc_date).ljust(14, "0")[:14]
    month, day = max("01", d[4:6]), max("01", d[6:8])
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, ident) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {ident}')}>"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its blank line) and payload; no header: empty."""
    if body.startswith(b"HTTP/"):
        at = body.find(GAP)
        if at >= 0:
            return body[: at + 4], body[at + 4 :]
        at = body.find(b"\n\n")
        if at >= 0:
            return body[: at + 2], body[at + 2 :]
    return b"", body


def warc_record(record: ArcRecord, ident=None, refers_to=None, refers_url: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the closing CRLF CRLF.

    ``refers_to`` makes it a revisit that keeps the HTTP header and no payload.
    """
    http, payload = split_http(record.body)
    date = warc_date(record.fields.get("Archive-date", ""))
    if record.url.startswith("filedesc://"):
        kind, content, block = "warcinfo", "application/warc-fields", f"software: lodestone\r\nformat: WARC File Format 1.0\r\nconvertedFrom: ARC version {record.version}\r\n".encode()
    elif refers_to is not None:
        kind, content, block = "revisit", "application/http; msgtype=response", http
    elif http:
        kind, content, block = "response", "application/http; msgtype=response", record.body
    else:
        kind, content, block = "resource", record.fields.get("Content-type") or "application/octet-stream", record.body
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(record.url, date, ident)), ("WARC-Date", date)]
    if kind != "warcinfo":
        head += [("WARC-Target-URI", record.url), ("WARC-IP-Address", record.fields.get("IP-address", "0.0.0.0")), ("WARC-Payload-Digest", sha1_base32(payload)), ("X-Payload-Length", str(len(payload)))]
        if ident is not None:
            head.append(("X-Source-Id", quote(str(ident))))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_url if refers_url is not None else record.url, date, refers_to)), ("X-Refers-To-Source-Id", quote(str(refers_to)))]
    if record.truncated:
        head.append(("WARC-Truncated", "length"))
    head += [("WARC-Block-Digest", sha1_base32(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return b"WARC/1.0" + CRLF + lines + CRLF + block


def arc_to_warc(data: bytes | BinaryIO) -> Iterator[bytes]:
    """All records of an ARC file as WARC records."""
    for record in parse_arc(data):
        yield warc_record(record) + GAP


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; memory is one record and one chunk."""
    held, done = bytearray(), False

    def more() -> bool:
        nonlocal done
        part = next(chunks, None)
        if part is None:
            done = True
            return False
        held.extend(part)
        return True

    while True:
        at = 0
        while True:  # blank lines between records
            while len(held) - at < 2 and more():
                pass
            if held[at : at + 2] == CRLF:
                at += 2
            else:
                break
        del held[:at]
        if not held and (done or not more()):
            return
        seen = 0
        while (end := held.find(GAP, max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                raise ValueError("WARC header without end")
        lines = bytes(held[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        need = end + 4 + int(head["Content-Length"])
        while len(held) < need:
            if not more():
                raise ValueError("WARC block shorter than declared")
        block = bytes(held[end + 4 : need])
        del held[:need]
        yield head, block


def _inflated(data: bytes, step: int = 1 << 20, feed: int = 1 << 14) -> Iterator[tuple[int, bytes]]:
    """(offset of the member, chunk) of a gzip file of one or many members; zero bytes
    after a member are padding."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, pos = zlib.decompressobj(31), at
        while not z.eof:
            if z.unconsumed_tail:
                part = z.decompress(z.unconsumed_tail, step)
            elif pos < len(view):
                part = z.decompress(view[pos : pos + feed], step)
                pos += feed
            else:
                raise ValueError("gzip file ends inside a member")
            if part:
                yield at, part
        at = min(pos, len(view)) - len(z.unused_data)
        while at < len(view) and not view[at]:
            at += 1


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Chunks of a gzip file of one or many members; other data passes through."""
    if data[:2] == b"\x1f\x8b":
        yield from (part for _, part in _inflated(data, step))
    else:
        for i in range(0, len(data), step):
            yield data[i : i + step]


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every member of an archive."""
    for at, parts in itertools.groupby(_inflated(data), key=lambda x: x[0]):
        yield at, b"".join(p for _, p in parts)


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _archives(records: Iterator[bytes], archive_bytes: int) -> Iterator[bytes]:
    """Whole archives of the records, without their last byte, which is 0."""

    def close(parts: list[bytes]) -> bytes:
        if parts[-1][-1]:  # a record of 16 MB or more: an empty member ends in 0
            parts.append(member(b""))
        return b"".join(parts)[:-1]

    parts: list[bytes] = []
    size = 0
    for record in records:
        part = member(record + GAP)
        if parts and size + len(part) > archive_bytes:
            yield close(parts)
            parts, size = [], 0
        parts.append(part)
        size += len(part)
    if parts:
        yield close(parts)


def _archive_rows(records: Iterator[bytes], archive_bytes: int):
    import pyarrow as pa

    for archive in _archives(records, archive_bytes):
        yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["archive"])


def _writer(version: int, date: str, archive_bytes: int):
    """Rows (id, url, html, refers_to, refers_url) to archives: each batch of rows
    becomes an ARC file in memory, which the converter reads."""
    block = arc_version_block(version, date=date)

    def run(batches):
        def records():
            yield warc_record(next(parse_arc(block)), "info")
            for whole in batches:
                for at in range(0, whole.num_rows, ARC_BATCH):
                    rows = list(zip(*(c.to_pylist() for c in whole.slice(at, ARC_BATCH).columns), strict=True))
                    legacy = [block]
                    for ident, url, html, _, _ in rows:
                        payload = (html or "").encode("utf-8", "surrogatepass")
                        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                        legacy.append(arc_record(version, encode_url(url, ident), http + payload, date))
                    found = parse_arc(b"".join(legacy))
                    next(found)  # the version block
                    for (ident, _, _, refers, refers_url), record in zip(rows, found, strict=True):
                        yield warc_record(record, ident, refers, None if refers is None else encode_url(refers_url, refers))

        yield from _archive_rows(records(), archive_bytes)

    return run


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, html, refers_to, refers_url): refers_to names the response that a
    page repeats. Only digests of payloads seen twice meet the pages; where they are
    many, the join is a shuffle that splits a hot payload. Payloads too short for a
    revisit go round the join."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    id_type = dict(rows.dtypes)["id"]
    long = F.octet_length("html") >= REVISIT_BYTES
    keyed = rows.where(long).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    best = F.max(F.struct("id", F.coalesce("url", F.lit("")).alias("url"))).alias("best")
    groups = keyed.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select("digest", F.col("best.id").alias("target"), F.col("best.url").alias("target_url"))
    met = keyed.join(exchanged(groups, "digest"), "digest", "left")
    again = F.col("target").isNotNull() & ~F.col("id").eqNullSafe(F.col("target"))
    judged = met.select("id", "url", "html", F.when(again, F.col("target")).alias("refers_to"), F.when(again, F.col("target_url")).alias("refers_url"))
    none = F.lit(None)
    return judged.union(rows.where(~long).select("id", "url", "html", none.cast(id_type).alias("refers_to"), none.cast("string").alias("refers_url")))


def _save(archives: DataFrame, path: str) -> None:
    """One archive a file; the separator restores its last byte."""
    archives.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, arc_version: int = 1, arc_date: str = "20200101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a WARC record per row to archives under ``path``."""
    _save(revisits(pages, id_col, url_col, html_col).mapInArrow(_writer(arc_version, arc_date, archive_bytes), "archive binary"), path)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


ARC_RECORDS = "file string, position long, version int, url string, ip string, date string, content_type string, result_code string, checksum string, location string, truncated boolean, body binary"


def _arc_reader(batches):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 7, pa.bool_(), pa.binary()]
    names = [f.split()[0] for f in ARC_RECORDS.split(", ")]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows: list[tuple] = []
            size = 0
            for position, r in enumerate(parse_arc(io.BufferedReader(_Chunks(inflate(content.as_py()))))):
                f = r.fields
                rows.append((file, position, r.version, r.url, f.get("IP-address"), f.get("Archive-date"), f.get("Content-type"), f.get("Result-code"), f.get("Checksum"), f.get("Location"), r.truncated, r.body))
                size += len(r.body)
                if size > 8 << 20:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)


def read_arc_files(spark: SparkSession, path: str, pattern: str = "*.arc*") -> DataFrame:
    """Source of ARC files under ``path``, plain or gzip-compressed in one member or
    many: a row a record, the version block (position 0) included."""
    return _files(spark, path, pattern).select("path", "content").mapInArrow(_arc_reader, ARC_RECORDS)


def convert_arc_files(spark: SparkSession, path: str, target: str, pattern: str = "*.arc*", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC files under ``path`` to WARC archives under ``target``; the files of one
    task share archives, and each begins with its warcinfo record."""

    def run(batches):
        def records():
            for b in batches:
                for content in b.column(0):
                    for r in parse_arc(io.BufferedReader(_Chunks(inflate(content.as_py())))):
                        yield warc_record(r)

        yield from _archive_rows(records(), archive_bytes)

    _save(_files(spark, path, pattern).select("content").mapInArrow(run, "archive binary"), target)


def _reader(batches):
    import pyarrow as pa

    names = ["record_type", "id", "url", "date", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for content in b.column(0):
            rows: list[tuple] = []
            size = 0
            for head, block in parse_warc(inflate(content.as_py())):
                if sha1_base32(block) != head["WARC-Block-Digest"]:
                    raise ValueError(f"block digest differs in {head['WARC-Record-ID']}")
                if head["WARC-Type"] == "warcinfo":
                    continue
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                length, payload = int(head["X-Payload-Length"]), None
                if head["WARC-Type"] != "revisit":
                    payload = split_http(block)[1]
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != length:
                        raise ValueError(f"payload digest differs in {head['WARC-Record-ID']}")
                own, refers = head.get("X-Source-Id"), head.get("X-Refers-To-Source-Id")
                rows.append((head["WARC-Type"], own and unquote(own), head["WARC-Target-URI"], head["WARC-Date"], length, digest, refers and unquote(refers), payload))
                size += len(block)
                if size > 8 << 20:
                    yield pack(rows)
                    rows, size = [], 0
            if rows:
                yield pack(rows)


RECORDS = "record_type string, id string, url string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_archives(spark: SparkSession, path: str, id_type: str = "long", pattern: str = "part-*") -> DataFrame:
    """Records of the archives under ``path``, digests verified; a revisit's
    length and digest are those of the payload it repeats, its payload is null.
    Identifiers come back as ``id_type``."""
    rows = _files(spark, path, pattern).select("content").mapInArrow(_reader, RECORDS)
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def round_trip(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write the pages' archives and read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, **columns)
    return read_archives(spark, path, dict(pages.dtypes)[columns.get("id_col", "page_id")])
