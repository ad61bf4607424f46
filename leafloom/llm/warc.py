"""WARC (1): archives written from and read into chunked record tables.

A chunked record table has a row for each chunk of a record's payload:
record id, chunk number, the chunk's bytes, and the payload's size and SHA-256
up to and with that chunk. A payload of any size passes through the reader and
the writer a chunk at a time; neither holds a whole record. An empty payload is
one empty chunk, so every record has a last chunk, whose size and digest are the
payload's.

Writers put one gzip member per record, a warcinfo record first, into files of
their own, named by partition and attempt, and report the files they finished. Only reported files
are read, so a task that ran twice, or died half way, leaves no trace in the
result. Archives lie in the shared folder, through a file system that pyarrow
opens by the folder's URI.

Of records with equal payloads of at least `min_revisit` bytes, the one with the
smallest id holds the payload (`response`); the others (`revisit`) name it, with
the payload's digest and size in their headers. Null payload counts as empty.
Record ids are name-based UUIDs; the row's own id stands in a field `Record-Key`
beside. Characters that a URI can't hold are percent-encoded and stay so when
read; a missing URI is `about:blank`, which reads as empty.

The reader takes archives of other writers as well: plain or gzip, field names
in any case, folded lines, bare line feeds. Responses, revisits and resources
give rows, other records none. A digest is checked if it is SHA-256 or SHA-1, in
hexadecimal or base 32, and the record is not marked as truncated. HTTP bodies
are payloads as they stand, transfer and content codings included. A record
without `Record-Key` is named by its record id.
Rows that repeat an id become records of their own, of which equal ones can't be
told apart. Rows without an id are never referred to. An empty table gives an
empty archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table, written

#: Bytes of payload in a chunk, and of compressed file read at a time.
CHUNK = 1 << 18
READ = 1 << 16
MIN_REVISIT = 100
#: A writer begins a new file beyond this.
FILE_BYTES = 64 << 20
#: The fields before a record's block may be this long at the most.
HEAD_BYTES = 1 << 20
NO_URI = "about:blank"
#: Characters that may stand in a URI as they are.
URI_SAFE = "%/:?#[]@!$&'()*+,;=-._~"

CHUNKS = "record_id string, uri string, record_type string, refers_to string, chunk_no long, data binary, n_bytes long, payload_bytes long, payload_digest string, last boolean"


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _folder(uri: str) -> str:
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """records (record_id, uri, record_type, refers_to, payload binary, digest, size) as chunk rows, each record's together and in order."""
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / chunk) - 1).cast("long")
    rows = records.withColumn("last_no", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_no"))))
    part = F.expr(f"substring(payload, cast(chunk_no * {chunk} + 1 as int), {chunk})")
    return rows.select("record_id", "uri", "record_type", "refers_to", "digest", "size", "chunk_no", (F.col("chunk_no") == F.col("last_no")).alias("last"), part.alias("data"))


def urn(key: str) -> str:
    """The record id of a row's own id; rows without one are all different."""
    return f"<{(uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}') if key else uuid.uuid4()).urn}>"


class ArchiveWriter:
    """Writes records chunk by chunk, each as a gzip member."""

    def __init__(self, folder: str, name: str, date: str):
        self.fs, self.root = open_fs(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.n, self.out, self.records, self.done, self.date = name, 0, None, 0, [], date

    def _open(self):
        name = f"{self.name}-{self.n:05d}.warc.gz"
        self.path = f"{self.root}/{name}"
        self.out, self.bytes, self.records = self.fs.open_output_stream(self.path, compression=None), 0, 0
        self.n += 1
        info = b"software: leafloom\r\nformat: WARC File Format 1.1\r\n"
        self._begin(["WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid4().urn}>", f"WARC-Date: {self.date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(info)}"])
        self._put(info)
        self._finish()

    def _begin(self, fields: list[str]):
        self.zip = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put("\r\n".join(["WARC/1.1", *fields, "", ""]).encode())

    def begin(self, record_id, uri, record_type, refers_to, digest, size):
        if self.out is None:
            self._open()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() if record_type == "response" else b""
        block = len(http) + (size if record_type == "response" else 0)
        fields = [
            f"WARC-Type: {record_type}",
            f"WARC-Record-ID: {urn(record_id)}",
            f"WARC-Date: {self.date}",
            f"WARC-Target-URI: {quote(uri, safe=URI_SAFE) if uri else NO_URI}",
            f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Payload-Length: {size}",
            f"Record-Key: {quote(record_id, safe='')}",
        ]
        if record_type == "revisit":
            fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}", f"Refers-To-Key: {quote(refers_to, safe='')}"]
        self._begin(fields + ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"])
        self._put(http)

    def _put(self, data: bytes):
        self._raw(self.zip.compress(data))

    def _raw(self, data: bytes):
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def payload(self, data: bytes):
        self._put(data)

    def _finish(self):
        self._put(b"\r\n\r\n")
        self._raw(self.zip.flush())

    def end(self):
        self._finish()
        self.records += 1
        if self.bytes >= FILE_BYTES:
            self.close()

    def close(self):
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.bytes))
            self.out = None


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer = ArchiveWriter(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId():08d}-{os.getpid()}", date)
        for batch in batches:
            columns = [batch.column(k) for k in range(8)]
            rows = zip(*(c.to_pylist() for c in columns))
            data = batch.column(8)
            for k, (record_id, uri, kind, refers_to, digest, size, no, last) in enumerate(rows):
                if no == 0:
                    writer.begin(record_id, uri, kind, refers_to, digest, size)
                if kind == "response":
                    writer.payload(data[k].as_buffer() or b"")
                if last:
                    writer.end()
        writer.close()
        done = writer.done
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in done], pa.string()), pa.array([n for _, n, _ in done], pa.int64()), pa.array([b for _, _, b in done], pa.int64())], names=["path", "n_records", "n_bytes"])

    return run


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes chunk rows to archives in folder; the manifest: path, n_records, n_bytes."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    made = chunks.mapInArrow(_write(_folder(folder), date), "path string, n_records long, n_bytes long")
    return written(made, "warc-manifest")


class Members:
    """The bytes of a file, plain or of gzip members, decompressed as they are asked for."""

    def __init__(self, stream):
        self.stream, self.zip, self.held, self.ended = stream, zlib.decompressobj(31), bytearray(), False
        self.first = stream.read(READ)
        self.plain = self.first[:2] != b"\x1f\x8b"

    def _raw(self) -> bytes:
        raw, self.first = self.first, b""
        return raw or self.stream.read(READ)

    def more(self) -> bool:
        """Decompresses some more; False at the end of the file."""
        while not self.ended:
            if self.plain:
                raw = self._raw()
                self.held += raw
                self.ended = not raw
                return bool(raw)
            raw = self.zip.unconsumed_tail or (self.zip.unused_data if self.zip.eof else b"")
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
            raw = raw or self._raw()
            if not raw:
                self.ended = True
                return False
            out = self.zip.decompress(raw, READ)
            if out:
                self.held += out
                return True
        return False

    def line(self) -> bytes | None:
        """Up to and without the next line feed and a carriage return before it; None at the end of the file."""
        at = 0
        while (found := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if at > HEAD_BYTES:
                raise ValueError("no end of line")
            if not self.more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + 1]
        return out.removesuffix(b"\r")

    def take_line(self, most: int) -> bytes:
        """The next line with its line feed, or `most` bytes of it."""
        at = 0
        while (found := self.held.find(b"\n", at)) < 0 and len(self.held) < most:
            at = len(self.held)
            if not self.more():
                break
        return self.take(min(most, found + 1 if found >= 0 else len(self.held)))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n > 0:
            gone = len(self.take(min(n, READ)))
            if not gone:
                return
            n -= gone


def read_fields(members: Members) -> dict[str, str] | None:
    """The fields of the next record, names in lower case; None at the end of the file."""
    version = members.line()
    while version is not None and not version.strip():
        version = members.line()
    if version is None:
        return None
    if not version.lstrip().upper().startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields, last, size = {}, None, 0
    while line := members.line():
        size += len(line)
        if size > HEAD_BYTES:
            raise ValueError("the fields of a record do not end")
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def digest_of(field: str | None):
    """(hash, digest in hexadecimal) of a digest field that can be checked, else None."""
    kind, _, value = (field or "").partition(":")
    kind, value = kind.strip().lower().replace("-", ""), value.strip()
    if kind not in ("sha1", "sha256"):
        return None
    size = hashlib.new(kind).digest_size
    if len(value) == 2 * size:
        return hashlib.new(kind), value.lower()
    try:
        found = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (hashlib.new(kind), found.hex()) if len(found) == size else None


def read_records(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows (as CHUNKS) of an archive; the digest is worked out from the payload as it passes."""
    members = Members(stream)
    while (fields := read_fields(members)) is not None:
        named = lambda own, other: unquote(fields[own]) if own in fields else fields.get(other, "").strip("<>") or None
        record_id, kind, uri = named("record-key", "warc-record-id"), fields.get("warc-type", "").lower(), fields.get("warc-target-uri", "").strip("<>")
        uri, left = "" if uri == NO_URI else uri, int(fields["content-length"])
        if kind == "revisit":
            members.skip(left)
            known, size = digest_of(fields.get("warc-payload-digest")), fields.get("warc-payload-length")
            yield record_id, uri, kind, named("refers-to-key", "warc-refers-to"), 0, b"", 0, int(size) if size else None, known[1] if known else None, True
            continue
        if kind not in ("response", "resource"):
            members.skip(left)
            continue
        if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            # the HTTP head ends with an empty line; what follows, up to the block's end, is the payload
            while left > 0:
                line = members.take_line(left)
                left -= len(line)
                if not line.rstrip(b"\r\n"):
                    break
        own, check, size, no = hashlib.sha256(), None if "warc-truncated" in fields else digest_of(fields.get("warc-payload-digest")), 0, 0
        while True:
            data = members.take(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError(f"record {record_id} is cut short")
            own.update(data)
            if check:
                check[0].update(data)
            left -= len(data)
            size += len(data)
            yield record_id, uri, kind, None, no, data, len(data), size, own.hexdigest(), left == 0
            no += 1
            if not left:
                break
        if check and check[0].hexdigest() != check[1]:
            raise ValueError(f"record {record_id} does not have its digest")


def _read(scheme: str, keep: bool):
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def ready(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, _ = open_fs(scheme)
                with filesystem.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for row in read_records(stream):
                        held += row[6] if keep else 0
                        rows.append(row if keep else (*row[:5], None, *row[6:]))
                        if len(rows) >= 4096 or held >= 8 * CHUNK:
                            yield ready(rows)
                            rows, held = [], 0
                    if rows:
                        yield ready(rows)

    return run


def read_archives(manifest: DataFrame, folder: str, keep_data: bool = True) -> DataFrame:
    """Chunk rows of the archives of a manifest; without data where only sizes and digests are wanted."""
    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(_read(_folder(folder), keep_data), CHUNKS)


def with_revisits(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """records (record_id long, uri, payload) with digest, size, record_type, refers_to (long)."""
    sized = records.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    keys = written(sized.select("record_id", "digest", "size"), "warc-keys")
    # a plain table: Spark can then split a digest that many rows have
    first = keys.where((F.col("size") >= min_revisit) & F.col("record_id").isNotNull()).groupBy("digest").agg(F.min("record_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    first = written(first, "warc-first")
    revisits = written(keys.join(first, "digest").where(F.col("record_id") > F.col("refers_to")).select("record_id", "digest", "refers_to").distinct(), "warc-revisits")
    # the payload is shuffled only if the revisits are too many to broadcast
    return sized.join(revisits, ["record_id", "digest"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row of pages; the manifest of the archives."""
    records = pages.select(F.col(page_id).cast("long").alias("record_id"), F.coalesce(F.col(url), F.lit("")).alias("uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    typed = with_revisits(records).withColumns({"record_id": F.coalesce(F.col("record_id").cast("string"), F.lit("")), "refers_to": F.col("refers_to").cast("string")})
    return write_archives(chunked(typed), folder)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = archive(table(spark, sf_dir, "pages"), folder)
    ends = read_archives(manifest, folder, keep_data=False).where("last")
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return ends.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP1_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id > first THEN first END AS refers_to
FROM f
"""
