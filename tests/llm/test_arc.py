import base64
import gzip
import hashlib
import uuid

import duckdb
import pytest

from glyphsieve.llm import arc as A

HTML = b"<html>\n\xc3\xa9\n\n</html>"
HTTP = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\n" + HTML
V1 = b"1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n"
V2 = b"2 0 someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def v1(*records):
    out = b"filedesc://a.arc 0.0.0.0 19961127101010 text/plain %d\n%s\n" % (len(V1), V1)
    return out + b"".join(b"%s %d\n%s\n" % (head, len(block), block) for head, block in records)


def v2(*records):
    out = b"filedesc://b.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 b.arc %d\n%s\n" % (len(V2), V2)
    return out + b"".join(b"%s %d\n%s\n" % (head, len(block), block) for head, block in records)


FILES = {
    "one": v1((b"http://x.example/a b 1.2.3.4 19970304050607 text/html", HTTP), (b"dns:x.example 9.9.9.9 199703040506 text/dns", b"20070101\nx"), (b"ftp://x.example/f 0.0.0.0 19970304 -", b"\n\nbinary\n")),
    "two": v2((b"https://x.example/ 1.2.3.4 20010229000000 text/html 404 - - 120 b.arc", HTTP), (b"http://x.example/old 1.2.3.4 20010203040506 text/html 200 - - 300 b.arc", b"<p>no header")),
    "short": v1((b"http://x.example/ 1.2.3.4 19970304050607 text/html", HTTP))[:-10],
    "wrong": v1() + b"http://x.example/ text/html ten\nabc\n",
    "noend": v1() + b"http://x.example/",
    "first": b"http://x.example/ 1.2.3.4 19970304050607 text/html 3\nabc\n",
    "version": v1().replace(b"1 0 someone", b"7 0 someone"),
    "v1 fields under version 2": v2((b"http://x.example/ 1.2.3.4 19970304050607 text/html", b"abc")),
    "empty": b"",
    "null": None,
    "gzip": b"".join(gzip.compress(x) for x in (v1(), b"http://x.example/z 1.2.3.4 19970304050607 text/html 3\nabc\n")),
    "cut gzip": gzip.compress(v1()) + gzip.compress(b"http://x.example/z 1.2.3.4 19970304050607 text/html 3\nabc\n")[:-12],
    "large": v1((b"http://x.example/l 1.2.3.4 19970304050607 application/octet-stream", b"HTTP/1.0 200 OK\n\n" + bytes(3_000_000)), (b"http://x.example/m 1.2.3.4 19970304050607 text/plain", b"")),
}


def base32(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, 1) for k, v in FILES.items()], "path string, content binary, record_no int")
    out = {}
    frame = A.to_warc(df)
    for r in frame.select("*", A.warc_bytes(frame).alias("warc")).collect():
        out.setdefault(r.path, []).append(r)
    return {k: sorted(v, key=lambda r: r.record_no) for k, v in out.items()}


def test_types_dates_and_digests(records):
    info, page, dns, ftp = records["one"]
    assert (info.warc_type, info.warc_date, info.warc_target_uri, info.payload_digest, bytes(info.block)) == ("warcinfo", "1996-11-27T10:10:10Z", None, None, V1)
    assert (page.warc_type, page.warc_target_uri, page.warc_ip_address, page.http_status) == ("response", "http://x.example/a b", "1.2.3.4", 404)
    assert page.block_digest == base32(HTTP) and page.payload_digest == base32(HTML) and page.content_length == len(HTTP)
    assert (dns.warc_type, dns.content_type, dns.warc_date) == ("response", "text/dns", "1997-03-04T05:06:00Z")
    assert (ftp.warc_type, ftp.content_type, ftp.warc_ip_address, ftp.warc_date, bytes(ftp.block)) == ("resource", "application/octet-stream", None, "1997-03-04T00:00:00Z", b"\n\nbinary\n")
    _, page, plain = records["two"]
    assert page.http_status == 404 and page.warc_date is None and page.error == "a date that can't be read"
    assert (plain.warc_type, plain.content_type, plain.error) == ("resource", "text/html", None)
    assert [bytes(r.block) for r in records["gzip"]] == [V1, b"abc"] and len(records["large"]) == 3 and records["large"][1].payload_digest == base32(bytes(3_000_000))


def convert(spark, *files):
    return sorted(A.to_warc(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")).collect(), key=lambda r: (r.path, r.record_no))


def test_identifiers_are_uuids_that_differ_and_stay(records, spark):
    ids = [r.warc_record_id for v in records.values() for r in v if r.warc_record_id]
    assert all(uuid.UUID(i[10:-1]).version == 5 for i in ids) and len(set(ids)) == len(ids)
    again = convert(spark, ("one", FILES["one"]))
    assert [r.warc_record_id for r in again] == [r.warc_record_id for r in records["one"]]
    same = (b"http://x.example/ 1.2.3.4 19970304050607 text/html", HTTP)
    both = convert(spark, ("p", v1(same, same)), ("q", v1(same)))
    assert len({r.warc_record_id for r in both}) == 5


@pytest.mark.parametrize("name,number,error", [("short", 1, "declared length"), ("wrong", 1, "fields"), ("noend", 1, "end"), ("first", 0, "version block"), ("version", 0, "unknown version"), ("v1 fields under version 2", 1, "fields")])
def test_what_cannot_be_read_is_said(records, name, number, error):
    last = records[name][-1]
    assert last.record_no == number and error in last.error and last.warc is None
    assert all(r.error is None for r in records[name][:-1])


def page(k, extra=b""):
    block = b"HTTP/1.1 200 OK\r\n\r\npage %d %s" % (k, extra * 3000)
    return b"http://x.example/%d 1.2.3.4 19970304050607 text/html %d\n%s\n" % (k, len(block), block)


def told(rows):
    return [r.warc_target_uri.rpartition("/")[2] if r.warc_target_uri else r.warc_type for r in rows if r.error is None], [r.error for r in rows if r.error]


@pytest.mark.parametrize("many", [False, True])
def test_a_damaged_member_loses_only_itself(spark, many):
    members = [gzip.compress(v1())] + [gzip.compress(page(k, bytes(range(256)))) for k in range(10)]
    hurt = bytearray(members[4])
    hurt[len(hurt) // 2] ^= 0xFF
    members[4] = bytes(hurt[:-9]) if many else bytes(hurt)
    good, errors = told(convert(spark, ("x", b"".join(members))))
    assert good[:4] == ["warcinfo", "0", "1", "2"] and good[-6:] == ["4", "5", "6", "7", "8", "9"] and any("gzip member" in e for e in errors)


def test_padding_between_members(spark):
    members = [gzip.compress(v1())] + [gzip.compress(page(k)) for k in range(5)]
    assert told(convert(spark, ("x", b"\0\0".join(members)))) == (["warcinfo", "0", "1", "2", "3", "4"], [])
    good, errors = told(convert(spark, ("x", b"??".join(members))))
    assert good == ["warcinfo", "0", "1", "2", "3", "4"] and errors == ["bytes between gzip members"] * 5
    whole = gzip.compress(v1() + page(0)) + b"\0" * 512 + gzip.compress(page(1) + page(2))  # several records a member
    assert told(convert(spark, ("x", whole))) == (["warcinfo", "0", "1", "2"], [])


def test_plain_files_go_on_after_damage(spark):
    good, errors = told(convert(spark, ("x", v1() + page(0) + b"garbage here\nmore of it\n" + page(1) + b"http://x.example/long 1.2.3.4 19970304050607 text/html 999999\nabc\n" + page(2))))
    assert good == ["warcinfo", "0", "1", "2"] and len(errors) == 2 and "24 bytes were not read" in errors[0] and "declared length" in errors[1]
    second = v2() + b"".join(b"http://x.example/%d 1.2.3.4 19970304050607 text/html 200 - - 7 b.arc 3\nabc\n%s" % (k, b"\xff\xfe\n" * k) for k in range(3))
    good, errors = told(convert(spark, ("x", second)))
    assert good == ["warcinfo", "0", "1", "2"] and len(errors) == 2


def test_nothing_from_nothing(records, spark):
    assert "empty" not in records and "null" not in records and told(records["cut gzip"])[1]
    assert A.to_warc(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_warc_bytes_read_back(records):
    data = b"".join(bytes(r.warc) for r in records["one"])
    seen = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        named = dict(x.split(": ", 1) for x in lines[1:])
        n = int(named["Content-Length"])
        seen.append((named["WARC-Type"], named.get("WARC-Target-URI"), rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n" and named["WARC-Block-Digest"] == base32(rest[:n])
        data = rest[n + 4 :]
    assert seen == [(r.warc_type, r.warc_target_uri, bytes(r.block)) for r in records["one"]]


@pytest.mark.parametrize("date,expected", [("20000229235959", "2000-02-29T23:59:59Z"), ("19000229000000", None), ("2000", None), ("20001301000000", None), ("200001010000", "2000-01-01T00:00:00Z"), ("x", None)])
def test_dates(date, expected):
    assert A.warc_date(date) == expected


def test_query_equals_sql_on_awkward_pages(spark, tmp_path):
    rows = [(1, "http://a.example/", "<p>é</p>", 0), (6, "http://a.example/", "<p>é</p>", 0), (1, "http://a.example/", "<p>é</p>", 0), (2, None, "x", 0), (3, "http://b.example/", None, 0), (4, "https://c.example/", "", 0), (None, "http://d.example/", "y" * 2_000_000, 0)]
    spark.createDataFrame(rows, "page_id long, url string, html string, path int").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    out = A.query(spark, str(tmp_path))
    expected = c.execute(f"SELECT {', '.join(out.columns)} FROM ({A.oracle()})").fetchall()
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected) and len(expected) == 12
