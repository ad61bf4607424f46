import hashlib
import io

from leafloom.llm import warc
from leafloom.llm.common import new_folder

PAGES = [
    (1, "https://a/ x?é", "<p>" + "long page " * 50),
    (2, "https://b", "<p>" + "long page " * 50),
    (3, None, None),
    (4, "https://c", ""),
    (5, "https://d", "short"),
    (6, "https://e", "short"),
    (7, "https://f", "é" * 400_000 + "\r\n\r\nend"),
    (7, "https://f", "é" * 400_000 + "\r\n\r\nend"),
    (8, "https://g", "é" * 400_000 + "\r\n\r\nend"),
    (None, "https://h", "<p>" + "long page " * 50),
]
SCHEMA = "page_id long, url string, html string"


def test_round_trip_in_chunks(spark):
    folder = new_folder(spark, "warc-test")
    manifest = warc.archive(spark.createDataFrame(PAGES, SCHEMA).repartition(2), folder)
    rows = warc.read_archives(manifest, folder).collect()
    records = {}
    for r in rows:
        records.setdefault((r.record_id, r.record_type, r.uri), []).append(r)
    for i, url, html in PAGES:
        payload = (html or "").encode()
        kind = "revisit" if i in (2, 8) else "response"
        parts = sorted(records[(str(i) if i else "", kind, (url or "").replace(" ", "%20").replace("é", "%C3%A9"))], key=lambda r: r.chunk_no)
        if kind == "revisit":
            assert [(p.refers_to, p.payload_bytes, p.payload_digest) for p in parts] == [("1" if i == 2 else "7", len(payload), hashlib.sha256(payload).hexdigest())]
            continue
        copies = sum(p.last for p in parts)
        assert b"".join(p.data for p in parts if copies == 1) == (payload if copies == 1 else b"")
        at = hashlib.sha256()
        for p in parts if copies == 1 else ():
            at.update(p.data)
            assert p.payload_digest == at.hexdigest() and len(p.data) <= warc.CHUNK
        assert {(p.payload_bytes, p.payload_digest) for p in parts if p.last} == {(len(payload), hashlib.sha256(payload).hexdigest())}


def test_empty_table(spark):
    folder = new_folder(spark, "warc-test")
    manifest = warc.archive(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_archives(manifest, folder).count() == 0


def test_reader_refuses_a_wrong_digest(tmp_path):
    writer = warc.ArchiveWriter(str(tmp_path), "t", "2024-01-01T00:00:00Z")
    writer.begin("1", "u", "response", None, "0" * 64, 3)
    writer.payload(b"abc")
    writer.end()
    writer.close()
    data = open(writer.done[0][0], "rb").read()
    try:
        list(warc.read_records(io.BytesIO(data)))
    except ValueError as e:
        assert "digest" in str(e)
    else:
        raise AssertionError("a wrong digest passed")


def test_archives_are_warc(tmp_path):
    """What the writer makes, taken apart by hand: one member a record, warcinfo first, UUIDs, dates and URIs as they should be."""
    import gzip
    import re

    writer = warc.ArchiveWriter(str(tmp_path), "t", "2026-01-02T03:04:05Z")
    for args, body in ((("7", "https://a/b c?d=é&e=%20#f", "response", None, hashlib.sha256(b"abc").hexdigest(), 3), b"abc"), (("8", "", "revisit", "7", hashlib.sha256(b"abc").hexdigest(), 3), None)):
        writer.begin(*args)
        if body:
            writer.payload(body)
        writer.end()
    writer.close()
    text = gzip.open(writer.done[0][0]).read().decode()
    records = re.split(r"\r\n\r\n(?=WARC/1\.1\r\n)", text.removesuffix("\r\n\r\n"))
    kinds = []
    for r in records:
        head, block = r.split("\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        kinds.append(fields["WARC-Type"])
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and fields["WARC-Date"] == "2026-01-02T03:04:05Z"
        assert len(block.encode()) == int(fields["Content-Length"])
    assert kinds == ["warcinfo", "response", "revisit"] and writer.done[0][1] == 2
    assert "WARC-Target-URI: https://a/b%20c?d=%C3%A9&e=%20#f\r\n" in records[1] and records[1].endswith("\r\n\r\nabc")
    assert f"WARC-Refers-To: {warc.urn('7')}\r\n" in records[2] and warc.urn("7") in records[1]


def test_reads_archives_of_other_writers():
    import base64
    import gzip

    body = b"x" * 300_000 + b"\r\n\r\nend"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    response = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:uuid:1>\r\nwarc-target-uri: <http://a/>\r\nX-Folded: a\r\n b\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s%s\r\n\r\n" % (sha1.encode(), len(http + body), http, body)
    request = b"WARC/1.0\nWARC-Type: request\nContent-Length: 5\n\nGET /\r\n\r\n"
    resource = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: text/plain\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    bare = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    revisit = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:4>\r\nWARC-Refers-To: <urn:uuid:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    parts = [response, request, resource, bare, revisit]
    for data in (b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts))):
        rows = list(warc.read_records(io.BytesIO(data)))
        whole = {}
        for r in rows:
            whole[r[0]] = whole.get(r[0], b"") + r[5]
        assert whole == {"urn:uuid:1": body, "urn:uuid:2": b"hi", "urn:uuid:3": b"", "urn:uuid:4": b""}
        assert [r[3] for r in rows if r[2] == "revisit"] == ["urn:uuid:1"] and [r[1] for r in rows if r[0] == "urn:uuid:1"][0] == "http://a/"
        assert [r[8] for r in rows if r[0] == "urn:uuid:1" and r[9]] == [hashlib.sha256(body).hexdigest()]
    cut = gzip.compress(response[:-200])
    try:
        list(warc.read_records(io.BytesIO(cut)))
    except ValueError as e:
        assert "cut short" in str(e)
    else:
        raise AssertionError("a record cut short passed")
