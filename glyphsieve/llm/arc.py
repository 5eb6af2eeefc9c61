"""Legacy archive converter: ARC files, version 1 or 2, to WARC records.

An ARC file begins with a version block, whose first line is a record header of its own and whose second line tells the version, hence what the header lines of
all records hold. Each record is its header line and as many bytes as that declares. Nothing in ARC names a record, so identifiers are derived from the file's
path, the record's place in it and what it says (a record that is converted again, after a lost executor, gets the same one), dates become W3C dates, types follow from the address and the content, and
digests are computed. Files are independent: nothing is shuffled.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm._common import text_batches
from glyphsieve.sources.tables import read_table

#: What header lines hold, by version.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
SCHEMA = (
    "path string, record_no int, warc_type string, warc_record_id string, warc_date string, warc_target_uri string, warc_ip_address string, "
    "content_type string, content_length long, http_status int, block_digest string, payload_digest string, block binary, error string"
)
_STATUS = re.compile(rb"HTTP/[0-9.]+ ([0-9]{3})")
_DATE = re.compile(r"(\d{4})(\d\d)(\d\d)(?:(\d\d)(\d\d)(\d\d)?)?")
_SLICE = 1 << 20


def digest(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | None) -> str:
    """A name-based identifier: bits of a SHA-1 in the form of a UUID of version 5."""
    h = hashlib.sha1("\n".join(p or "" for p in parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{'89ab'[int(h[16], 16) & 3]}{h[17:20]}-{h[20:32]}>"


def warc_date(date: str) -> str | None:
    """The W3C form of YYYYMMDD[hhmm[ss]]; None for what is no date."""
    m = _DATE.fullmatch(date)
    if not m:
        return None
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups())
    longest = (31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    if not (1 <= mo <= 12 and 1 <= d <= longest[mo - 1] and h < 24 and mi < 60 and s < 60):
        return None
    return f"{y:04}-{mo:02}-{d:02}T{h:02}:{mi:02}:{s:02}Z"


_MEMBER = b"\x1f\x8b\x08"
_PIECE = 1 << 16


def _member(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What a gzip member from `at` on holds, as far as it can be read; and where it ends, None if it's damaged."""
    d, out, begin = zlib.decompressobj(31), [], at
    try:
        while not d.eof and begin < len(data):
            out.append(d.decompress(data[begin : begin + _PIECE]))
            begin += _PIECE
    except zlib.error:
        return b"".join(out), None
    return b"".join(out), min(begin, len(data)) - len(d.unused_data) if d.eof else None


def _next_member(data: bytes, at: int) -> int:
    """Where the next gzip member begins, by its header and the first bytes that it holds; the end of data, if there is none."""
    while (at := data.find(_MEMBER, at)) >= 0:
        if len(data) > at + 3 and not data[at + 3] & 0xE0:
            try:
                if zlib.decompressobj(31).decompress(data[at : at + 512]):
                    return at
            except zlib.error:
                pass
        at += 1
    return len(data)


def inflate(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The parts of a file that can be read without a break, each with what is wrong behind it: a file of gzip members, one a record or any other way, as it was before;
    other files as they are. Zeros between members are padding. A damaged member gives what can be read of it, and reading goes on at the next one."""
    if data[:2] != _MEMBER[:2]:
        yield data, None
        return
    at, out = 0, []
    while at < len(data):
        if data[at : at + 3] == _MEMBER:
            got, end = _member(data, at)
            out.append(got)
            if end is not None:
                at = end
                continue
            wrong, found = "a gzip member that can't be read", _next_member(data, at + 1)
        else:
            found = _next_member(data, at)
            wrong = "bytes between gzip members" if data[at:found].strip(b"\0") else None
        at = found
        if wrong:
            yield b"".join(out), wrong
            out = []
    yield b"".join(out), None


@dataclass
class Record:
    record_no: int
    url: str = ""
    ip: str | None = None
    date: str = ""
    mime: str = ""
    block: bytes = b""
    error: str | None = None


def _headers(version: int) -> re.Pattern:
    """Lines that look like the header of a record: an address, an internet address, a date, what else the version has, a length."""
    between = b"".join(b" [^ \n]+" for _ in FIELDS[version][3:-1])
    return re.compile(rb"^[A-Za-z][A-Za-z0-9+.-]*:[^\n]* [0-9A-Fa-f.:-]+ [0-9]{8,14}" + between + rb" [0-9]+\r?$", re.M)


_HEADERS = {v: _headers(v) for v in FIELDS}


def _next_header(data: bytes, at: int, version: int) -> int:
    found = _HEADERS[version].search(data, at)
    return found.start() if found else len(data)


def parse(content: bytes) -> Iterator[Record]:
    """The records of a file, the version block first. What can't be read is a record with an error, and reading goes on at the next line that looks like a header: no
    record goes without one. Where the file's version can't be told, nothing else is read."""
    number, version = 0, 1
    for data, wrong in inflate(content):
        at = 0
        while True:
            while data[at : at + 1] in (b"\n", b"\r"):
                at += 1
            if at >= len(data):
                break
            end = data.find(b"\n", at)
            line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
            if number == 0:
                told = data[end + 1 : data.find(b"\n", end + 1)].split(b" ")[0] if end >= 0 else b""
                if not line.startswith("filedesc:") or told not in (b"1", b"2"):
                    yield Record(0, error=f"unknown version {told[:20].decode('utf-8', 'replace')!r}" if line.startswith("filedesc:") and end >= 0 else "no version block")
                    return
                version = int(told)
            names = FIELDS[version]
            # addresses may hold spaces; no later field does
            values = line.rsplit(" ", len(names) - 1)
            if end < 0 or len(values) < len(names) or not re.fullmatch("[0-9]+", values[-1]):
                found = _next_header(data, at + 1, version)
                what = "a header line without an end" if end < 0 else "a header line without the fields of its version"
                yield Record(number, error=f"{what}: {found - at} bytes were not read")
                at, number = found, number + 1
                continue
            got, length = dict(zip(names, values)), int(values[-1])
            stop, error = end + 1 + length, None
            if stop > len(data):
                stop = _next_header(data, end + 1, version)
                error = "a declared length beyond the end of what can be read"
            ip = got["ip"] if got["ip"] not in ("-", "0.0.0.0", "") else None
            yield Record(number, got["url"], ip, got["date"], got["mime"], data[end + 1 : stop], error)
            at, number = stop, number + 1
        if wrong:
            yield Record(number, error=wrong)
            if number == 0:
                return
            number += 1


def converted(path: str | None, r: Record) -> dict:
    """A row of SCHEMA."""
    row = dict.fromkeys(("warc_type", "warc_record_id", "warc_date", "warc_target_uri", "warc_ip_address", "content_type", "content_length", "http_status", "block_digest", "payload_digest", "block"))
    row |= {"path": path, "record_no": r.record_no, "error": r.error}
    if r.error and not r.url:
        return row
    row["warc_date"], scheme = warc_date(r.date), r.url.partition(":")[0].lower()
    if row["warc_date"] is None and not r.error:
        row["error"] = "a date that can't be read"
    payload, status = r.block, _STATUS.match(r.block)
    if r.record_no == 0:
        kind, mime = "warcinfo", r.mime
    elif scheme in ("http", "https") and status:
        kind, mime = "response", "application/http;msgtype=response"
        ends = [(i, n) for i, n in ((r.block.find(b"\r\n\r\n"), 4), (r.block.find(b"\n\n"), 2)) if i >= 0]
        payload = r.block[sum(min(ends)) :] if ends else b""
        row["http_status"] = int(status[1])
    elif scheme == "dns":
        kind, mime = "response", "text/dns"
    else:
        kind, mime = "resource", r.mime if r.mime not in ("-", "") else "application/octet-stream"
    row |= {"warc_type": kind, "content_type": mime, "content_length": len(r.block), "warc_ip_address": r.ip, "block": r.block, "block_digest": digest(r.block)}
    if kind == "warcinfo":
        row["warc_target_uri"] = None
    else:
        row["warc_target_uri"], row["payload_digest"] = r.url, digest(payload)
    row["warc_record_id"] = record_id(path, str(r.record_no), r.url, r.date, row["block_digest"])
    return row


_FIELDS = pa.schema(
    [("path", pa.string()), ("record_no", pa.int32()), *((n, pa.string()) for n in ("warc_type", "warc_record_id", "warc_date", "warc_target_uri", "warc_ip_address", "content_type"))]
    + [("content_length", pa.int64()), ("http_status", pa.int32()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("block", pa.binary()), ("error", pa.string())]
)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, size = [], 0
            for r in parse(content.as_py() if content.is_valid else b""):
                rows.append(converted(path, r))
                size += len(r.block)
                if size > _SLICE:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)


def to_warc(files: DataFrame) -> DataFrame:
    """Records (SCHEMA) of ARC files(path, content), plain or gzipped, such as spark.read.format("binaryFile") gives. content may not exceed 2 GB.

    Version blocks become warcinfo records of their own type, HTTP responses response, DNS answers response of type text/dns, all else resource. What can't be read gives
    a record with `error`, without the fields that it hasn't, and the records after it are read: a damaged gzip member, bytes between members, a header line that doesn't
    fit the version, a length beyond the end. A date that can't be read leaves warc_date null. Identifiers differ within a file, whatever its records say, and between
    paths. A null or empty content gives nothing; repeated files give repeated rows. Other columns are ignored.
    """
    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(_convert, SCHEMA)


def warc_bytes(records: DataFrame) -> Column:
    """The WARC/1.1 record of each row of to_warc() that has no error, ready to be written one after the other; null for others."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    r = records
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", r.warc_type), line("WARC-Record-ID", r.warc_record_id), line("WARC-Date", r.warc_date), line("WARC-Target-URI", r.warc_target_uri),
        line("WARC-IP-Address", r.warc_ip_address), line("WARC-Block-Digest", r.block_digest), line("WARC-Payload-Digest", r.payload_digest),
        line("Content-Type", r.content_type), line("Content-Length", r.content_length), F.lit("\r\n"),
    )
    return F.when(r.error.isNull(), F.concat(F.encode(head, "utf-8"), r.block, F.encode(F.lit("\r\n\r\n"), "utf-8")))


def arc_file(rows: Iterator[tuple[str, str, str, bytes]], version: int, name: str) -> bytes:
    """An ARC file of rows (url, 14-digit date, type, content), a gzip member a record where the version is 2."""
    names = "URL IP-address Archive-date Content-type " + ("Archive-length" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length")
    told = f"{version} 0 glyphsieve\n{names}\n".encode()
    more = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 20200101000000 text/plain{more} {len(told)}\n".encode() + told + b"\n"]
    at = len(out[0])
    for url, date, mime, content in rows:
        more = "" if version == 1 else f" 200 - - {at} {name}"
        out.append(f"{url} 0.0.0.0 {date} {mime}{more} {len(content)}\n".encode() + content + b"\n")
        at += len(out[-1])
    return b"".join(out) if version == 1 else b"".join(gzip.compress(x, 1, mtime=0) for x in out)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, html in text_batches(batches, 2, _SLICE):
        paths, files = [], []
        for page, url, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), html.to_pylist()):
            if url is not None:
                body, n = (text or "").encode(), page or 0
                date = f"20200101{n // 3600 % 24:02}{n // 60 % 60:02}{n % 60:02}"
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                paths.append(f"page-{page}.arc")
                files.append(arc_file(iter([(url, date, "text/html", head + body)]), n % 2 + 1, paths[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as ARC files(path, content), a page a file, plain ones of version 1 and gzipped ones of version 2: the archives that the test tables lack.
    A page without a URL has no record in ARC, and gives no file; a null html is an empty one."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_pages, "path string, content binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All WARC records of the archived pages, version blocks included: what is told of each, and the record itself, as text."""
    records = to_warc(pages_as_arc(read_table(spark, sf_dir, "pages")))
    return records.withColumn("warc", F.decode(warc_bytes(records), "utf-8")).drop("block")


def oracle() -> str:
    """DuckDB SQL for query()."""

    def base32(x: str) -> str:
        part = f"CAST('0x' || substr(sha1({x}), i * 5 + 1, 5) AS INTEGER)"
        letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({part} >> {5 * k}) & 31) + 1, 1)" for k in (3, 2, 1, 0))
        return f"'sha1:' || array_to_string(list_transform(range(0, 8), lambda i: {letters}), '')"

    crlf = "chr(13) || chr(10)"
    head = lambda name, value: f"'{name}: ' || {value} || {crlf}"
    tail = f"|| {head('Content-Type', 'content_type')} || {head('Content-Length', 'content_length')} || {crlf} || block || {crlf} || {crlf}"
    begin = f"'WARC/1.1' || {crlf} || {head('WARC-Type', 'warc_type')} || {head('WARC-Record-ID', 'warc_record_id')} || {head('WARC-Date', 'warc_date')}"
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    version = " ".join(f"WHEN {v} THEN '{v} 0 glyphsieve' || chr(10) || '{f}' || chr(10)" for v, f in fields.items())
    return f"""
WITH raw AS (SELECT url, coalesce(html, '') AS body, coalesce(CAST(page_id AS BIGINT), 0) AS p, 'page-' || coalesce(CAST(page_id AS VARCHAR), 'None') || '.arc' AS path FROM pages WHERE url IS NOT NULL),
dated AS (SELECT *, printf('%02d', p // 3600 % 24) AS h, printf('%02d', p // 60 % 60) AS m, printf('%02d', p % 60) AS s,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || octet_length(encode(body)) || {crlf} || {crlf} || body AS block FROM raw),
recs AS (SELECT path, 1 AS record_no, 'response' AS warc_type, url, '20200101' || h || m || s AS date, '2020-01-01T' || h || ':' || m || ':' || s || 'Z' AS warc_date, 'application/http;msgtype=response' AS content_type, 200 AS http_status, block, body FROM dated
  UNION ALL SELECT path, 0, 'warcinfo', 'filedesc://' || path, '20200101000000', '2020-01-01T00:00:00Z', 'text/plain', NULL, CASE p % 2 + 1 {version} END, NULL FROM raw),
digested AS (SELECT *, CAST(octet_length(encode(block)) AS BIGINT) AS content_length, {base32("encode(block)")} AS block_digest, CASE WHEN record_no = 1 THEN {base32("encode(body)")} END AS payload_digest FROM recs),
named AS (SELECT *, sha1(path || chr(10) || record_no || chr(10) || url || chr(10) || date || chr(10) || block_digest) AS x FROM digested),
told AS (SELECT *, '<urn:uuid:' || substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(x, 17, 1) AS INTEGER) & 3) + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) || '>' AS warc_record_id FROM named)
SELECT path, CAST(record_no AS INTEGER) AS record_no, warc_type, warc_record_id, warc_date, CASE WHEN record_no = 1 THEN url END AS warc_target_uri, CAST(NULL AS VARCHAR) AS warc_ip_address, content_type, content_length,
  CAST(http_status AS INTEGER) AS http_status, block_digest, payload_digest, CAST(NULL AS VARCHAR) AS error,
  CASE record_no WHEN 1 THEN {begin} || {head('WARC-Target-URI', 'url')} || {head('WARC-Block-Digest', 'block_digest')} || {head('WARC-Payload-Digest', 'payload_digest')} {tail} ELSE {begin} || {head('WARC-Block-Digest', 'block_digest')} {tail} END AS warc
FROM told"""
