"""Web archives written and read as tables of chunk rows.

Writing: payloads are cut into (page, chunk number) rows; every task streams its rows,
one chunk in hand, into one gzip-per-record WARC/1.1 file in the shared folder, after a
warcinfo record, and returns a manifest row; files of attempts that were lost are in no
manifest and are never read. Reading: every task streams the files it was dealt and
yields (record, chunk number) rows with the running length and digest, holding one
chunk at a time whatever the record's size. A page's length and digest are those of
its record's last chunk, taken from the chunk rows by an aggregate.

Archives go through pyarrow's file systems, by the full URI that Hadoop gives the
folder: local, HDFS, S3 and others that pyarrow knows.

Defined cases: a null payload is empty; a null url gives an empty target; page_id is a
page's identity: rows that repeat it share a record identifier, and those with an equal
payload are all responses; a null page_id revisits an equal payload of another page, if
there is one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import cut, qualified, scratch_path

CHUNK_BYTES = 1 << 20
#: Equal payloads of at least this many bytes are stored once.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record string, page_id long, url string, record_type string, refers_to long, chunk_no int, n_bytes long, digest string, last boolean, data binary"


def base32(hex_digest: str) -> str:
    """Bare upper-case base32 of a hexadecimal digest."""
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages plus sha1, n_bytes, record_type and refers_to; only narrow rows are grouped."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("n_bytes", F.octet_length("html").cast("long"))
    groups = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(cut(groups, "payloads"), ["sha1", "n_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", "sha1", "n_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def payload_chunks(typed: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each response's payload, in order, and one without data for each revisit."""
    stored = F.when(F.col("record_type") == "response", F.col("n_bytes")).otherwise(0)
    last = F.greatest(F.ceil(stored / chunk_bytes) - 1, F.lit(0)).cast("int")
    rows = typed.select("page_id", "url", "record_type", "refers_to", "sha1", "n_bytes", F.col("html").cast("binary").alias("payload"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    data = F.when(F.col("record_type") == "response", F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})"))
    return rows.select("page_id", "url", "record_type", "refers_to", "sha1", "n_bytes", "chunk_no", data.alias("data"))


def record_head(page_id, url: str, kind: str, refers_to, digest: str, n_payload: int) -> bytes:
    """The named fields of a record and the HTTP head of its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_payload}\r\n\r\n".encode()
    safe = "".join(c for c in url or "" if c.isprintable())
    fields = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    fields.append(f"Content-Length: {len(http) + (0 if kind == 'revisit' else n_payload)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def info_record(name: str) -> bytes:
    """The warcinfo record that begins a file."""
    body = b"software: cairn\r\nformat: WARC File Format 1.1\r\n"
    fields = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}.warc.gz", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Records:
    """Gzip members written one after another to a file that is opened at the first."""

    def __init__(self, folder: str):
        self.store, self.at = pafs.FileSystem.from_uri(folder)
        self.out, self.path, self.records, self.squeeze = None, "", 0, None

    def begin(self, head: bytes) -> None:
        self.end()
        if self.out is None:
            self.store.create_dir(self.at, recursive=True)
            name = uuid.uuid4().hex
            self.path = f"{self.at}/{name}.warc.gz"
            self.out = self.store.open_output_stream(self.path, compression=None)
            self.out.write(gzip.compress(info_record(name), 6, mtime=0))
        self.squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.add(head)

    def add(self, data: bytes) -> None:
        self.out.write(self.squeeze.compress(data))

    def end(self) -> None:
        if self.squeeze is not None:
            self.add(b"\r\n\r\n")
            self.out.write(self.squeeze.flush())
            self.squeeze, self.records = None, self.records + 1


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = _Records(folder)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("chunk_no", "page_id", "url", "record_type", "refers_to", "sha1", "n_bytes")]
            for data, number, page_id, url, kind, refers_to, sha1, n_bytes in zip(batch.column("data"), *cols, strict=True):
                if number == 0:
                    file.begin(record_head(page_id, url, kind, refers_to, base32(sha1), n_bytes))
                if data.is_valid:
                    file.add(memoryview(data.as_buffer()))
        file.end()
        if file.out is not None:
            file.out.close()
            yield pa.RecordBatch.from_pydict({"file": [file.path], "records": pa.array([file.records], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> tuple[str, DataFrame]:
    """Write all pages; the folder and the manifest (file, records)."""
    folder = qualified(pages.sparkSession, folder or scratch_path(pages.sparkSession, "warc"))
    chunks = payload_chunks(record_types(pages, min_bytes), chunk_bytes)
    return folder, cut(chunks.mapInArrow(_writer(folder), "file string, records long"), "manifest")


class _Inflated:
    """A gzip file of many members as a stream of bytes, some at a time."""

    def __init__(self, raw, step: int):
        self.raw, self.step, self.zip, self.left, self.held = raw, step, zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        while True:
            if self.zip.eof:
                self.left, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            fed = self.left or bytes(self.raw.read(self.step))
            if not fed:
                return False
            got = self.zip.decompress(fed, self.step)
            self.left = self.zip.unconsumed_tail
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to the mark, which is dropped; None at the end."""
        seen = 0
        while (k := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                return None
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def some(self, most: int) -> bytes:
        if not self.held and not self.more():
            raise EOFError("archive ends within a record")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.some(n))

    def exactly(self, n: int) -> bytes:
        parts = bytearray()
        while len(parts) < n:
            parts += self.some(n - len(parts))
        return bytes(parts)


def _id(field: str | None) -> int | None:
    found = (field or "").rpartition(":")[2].rstrip(">")
    return int(found) if found.lstrip("-").isdigit() else None


def records(stream: _Inflated, chunk_bytes: int, with_data: bool, name: str = "") -> Iterator[tuple]:
    """Chunk rows of one archive; n_bytes and digest are those of all bytes so far."""
    found = 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        kind, left = fields["WARC-Type"], int(fields["Content-Length"])
        if kind not in ("response", "revisit"):
            stream.skip(left + 4)
            continue
        http = stream.until(b"\r\n\r\n")
        left -= len(http) + 4
        base = (f"{name}:{found}", _id(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI", ""), kind, _id(fields.get("WARC-Refers-To")))
        found += 1
        if kind == "revisit":
            stream.skip(left)
            yield (*base, 0, 0, fields["WARC-Payload-Digest"].partition(":")[2], True, None)
        else:
            running, done, number = hashlib.sha1(), 0, 0
            while True:
                piece = stream.exactly(min(chunk_bytes, left))
                running.update(piece)
                done, left = done + len(piece), left - len(piece)
                yield (*base, number, done, base32(running.hexdigest()), left == 0, piece if with_data else None)
                number += 1
                if not left:
                    break
        stream.skip(4)


def _reader(folder: str, chunk_bytes: int, with_data: bool):
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for files in batches:
            for path in files.column("file").to_pylist():
                with store.open_input_stream(path, compression=None) as raw:
                    rows, held = [], 0
                    for row in records(_Inflated(raw, chunk_bytes), chunk_bytes, with_data, path.rpartition("/")[2].partition(".")[0]):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if len(rows) >= 4096 or held >= 8 * chunk_bytes:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return run


def read_archives(folder: str, manifest: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of all archives in the manifest."""
    files = manifest.count()
    return manifest.select("file").repartition(max(1, files)).mapInArrow(_reader(folder, chunk_bytes, with_data), CHUNKS)


def whole_records(chunks: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, n_bytes, digest of each record, from all its chunk rows; fails where one is missing."""
    last = F.max(F.struct("chunk_no", "n_bytes", "digest", "last"))
    rows = chunks.groupBy("record", "page_id", "record_type", "refers_to").agg(F.count("*").alias("chunks"), last.alias("end"))
    whole = (F.col("end.chunk_no") + 1 == F.col("chunks")) & F.col("end.last")
    n_bytes = F.when(whole, F.col("end.n_bytes")).otherwise(F.raise_error(F.concat(F.lit("chunks are missing of record "), "record")).cast("long"))
    return rows.select("page_id", "record_type", "refers_to", n_bytes.alias("n_bytes"), F.col("end.digest").alias("digest"))


def page_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder, manifest = write_archives(pages, None, min_bytes)
    ends = cut(whole_records(read_archives(folder, manifest, with_data=False)), "records")
    whole = ends.where("record_type = 'response'").groupBy(F.col("page_id").alias("at"), F.col("digest").alias("sum")).agg(F.max("n_bytes").alias("stored"))
    out = ends.join(cut(whole, "responses"), (F.col("refers_to") == F.col("at")) & (F.col("digest") == F.col("sum")), "left")
    return out.select("page_id", F.when(F.col("record_type") == "revisit", F.col("stored")).otherwise(F.col("n_bytes")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


#: The bytes of a SHA-1 as 8 groups of 20 bits, each 4 letters of base32.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform(range(4), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * j)) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM g"""
