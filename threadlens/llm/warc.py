"""WARC archives through a chunked record table.

A payload is cut into rows of (record, chunk number, bytes); a writer streams the rows of a record in order into a gzip
member of its own and carries the SHA-1 along, so no task allocates a record. Each task writes one archive into the shared
folder under a name of its own attempt; only archives that a finished task reports in the manifest count, so a lost
executor's half-written file is never read. Reading streams an archive back into chunk rows: record, chunk number, bytes so
far and the digest so far; the last row of a record has the digest of all of it.

Of records with equal payloads of at least ``revisit_bytes``, the one with the largest page_id is a response and the others
are revisits that refer to it. A revisit keeps the HTTP headers, with the payload's length, and the payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import shared_path, table, written

CHUNK, REVISIT_BYTES = 16_384, 0
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:page:"
CHUNKS_SQL = (
    "record string, refers_to string, record_type string, uri string, payload_bytes long, "
    "chunk int, chunk_bytes int, bytes_so_far long, digest_so_far string, last boolean"
)


def _open_fs(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.replace("file:", "file://", 1)
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header(page_id: str, uri: str, kind: str, refers_to: str | None, digest: str, payload_bytes: int) -> bytes:
    """The WARC header and the HTTP header of a record; a response's payload follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = len(http) + (payload_bytes if kind == "response" else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_URN}{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {block}",
    ]
    if refers_to is not None:
        lines.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.insert(5, f"WARC-Refers-To: <{_URN}{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(folder: str):
    """Chunk rows in order -> one archive and its line of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open_fs(folder)
        name, out, records = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page, uri, kind, refers, sha1, size, _, last, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                    fresh = True
                if fresh:
                    packer, digest, fresh = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), False
                    uri = quote(uri or "", safe="%/:?#[]@!$&'()*+,;=~")
                    head = header(page, uri, kind, refers, base32(bytes.fromhex(sha1)), size)
                    out.write(packer.compress(head))
                digest.update(chunk)
                if kind == "response":
                    out.write(packer.compress(chunk))
                if last:
                    if kind == "response" and digest.hexdigest() != sha1:
                        raise ValueError(f"page {page}: chunks don't make up the payload")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    fresh, records = True, records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["archive", "records"])

    return run


def chunk_rows(pages: DataFrame, chunk: int = CHUNK, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, uri, record_type, refers_to, sha1, payload_bytes, chunk, last, bytes; revisits have one, empty chunk.

    page_id is of any type; ids are written as strings. Of pages with an equal payload and null ids all are revisits."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    # payloads move once, by page and digest; which page keeps a payload is found on digests alone, the copies of one
    # payload dealt to SALTS keys
    ids = written(rows.select("page_id", "sha1"), "digests")
    keep = ids.groupBy("sha1").agg(F.max("page_id").alias("keep"))
    keep = keep.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    kept = ids.distinct().withColumn("salt", salt).join(keep, ["sha1", "salt"])
    kept = written(kept.select(F.col("page_id").alias("k_id"), F.col("sha1").alias("k_sha1"), "keep"), "payloads")
    rows = rows.join(kept, F.col("page_id").eqNullSafe(F.col("k_id")) & (F.col("sha1") == F.col("k_sha1")))
    again = (F.col("payload_bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("keep"))
    n = F.when(F.col("record_type") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk)))
    at = F.col("chunk") * chunk + 1
    part: Column = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring("payload", at, F.lit(chunk)))
    return (
        rows.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("keep").cast("string")))
        .withColumn("chunks", n.cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        .select(
            F.col("page_id").cast("string").alias("page_id"), "uri", "record_type", "refers_to", "sha1", "payload_bytes",
            "chunk", (F.col("chunk") == F.col("chunks") - 1).alias("last"), part.alias("bytes"),
        )
    )


def write_archives(pages: DataFrame, folder: str, chunk: int = CHUNK, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the manifest: archive, records.

    Null html is an empty payload, a null url an empty URI. Rows that repeat a page_id are records of their own; if they
    share the payload, all with the largest page_id are responses. An empty table writes no archive. ``folder`` is a path
    or URI that driver and executors share and that pyarrow can open.
    """
    rows = chunk_rows(pages, chunk, revisit_bytes)  # a record's chunks come out of one row, so in order and together
    return written(rows.mapInArrow(_write(folder), "archive string, records long"), "manifest")


class _Stream(io.RawIOBase):
    """Gzip members of an archive, one after the other, in bounded pieces."""

    def __init__(self, source, piece: int = 1 << 16):
        self.source, self.piece, self.left = source, piece, b""
        self.unpack = zlib.decompressobj(31)
        self.ready = b""

    def more(self) -> bool:
        while not self.ready:
            if self.unpack.eof:
                self.left, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            data = self.left or self.unpack.unconsumed_tail or self.source.read(self.piece)
            self.left = b""
            if not data:
                return False
            self.ready = self.unpack.decompress(data, self.piece)
            self.left = b"" if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def line(self) -> bytes:
        out = b""
        while self.more():
            at = self.ready.find(b"\n")
            if at >= 0:
                out, self.ready = out + self.ready[: at + 1], self.ready[at + 1 :]
                return out
            out, self.ready = out + self.ready, b""
        return out

    def take(self, n: int) -> bytes:
        out = []
        while n and self.more():
            out.append(self.ready[:n])
            self.ready = self.ready[n:]
            n -= len(out[-1])
        return b"".join(out)


def _fields(stream: _Stream) -> dict[str, str]:
    out = {}
    while (line := stream.line().rstrip(b"\r\n")) != b"":
        key, _, value = line.decode("utf-8", "replace").partition(":")
        out[key.lower()] = value.strip()
    return out


def _read(folder: str, chunk: int):
    """archive -> chunk rows."""

    def rows(name: str) -> Iterator[tuple]:
        fs, _ = _open_fs(folder)
        with fs.open_input_stream(name, compression=None) as source:
            stream = _Stream(source)
            while stream.more():
                if not stream.line().startswith(b"WARC/"):
                    continue
                head = _fields(stream)
                record = head["warc-record-id"].strip("<>").removeprefix(_URN)
                refers = head["warc-refers-to"].strip("<>").removeprefix(_URN) if "warc-refers-to" in head else None
                status = stream.line()
                http = _fields(stream)
                size, kind = int(http["content-length"]), head["warc-type"]
                told = head["warc-payload-digest"].removeprefix("sha1:")
                base = (record, refers, kind, head.get("warc-target-uri"), size)
                if not status.startswith(b"HTTP/"):
                    raise ValueError(f"{name}: record {record} has no HTTP header")
                if kind == "revisit":
                    yield (*base, 0, 0, size, told, True)
                    continue
                digest, done, i = hashlib.sha1(), 0, 0
                while True:
                    data = stream.take(min(chunk, size - done))
                    digest.update(data)
                    done += len(data)
                    last = done == size
                    so_far = base32(digest.copy().digest())
                    if (last and so_far != told) or (not last and not data):
                        raise ValueError(f"{name}: record {record} is damaged")
                    yield (*base, i, len(data), done, so_far, last)
                    if last:
                        break
                    i += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in CHUNKS_SQL.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out: list[tuple] = []
                for row in rows(name):
                    out.append(row)
                    if len(out) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def read_archives(manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives in the manifest; digests are checked against the headers."""
    n = max(1, manifest.count())
    return manifest.select("archive").repartition(n).mapInArrow(_read(folder, chunk), CHUNKS_SQL)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = shared_path(spark, "warc"), table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    rows = read_archives(write_archives(pages, folder), folder)
    return rows.filter("last").select(
        F.col("record").cast(kind).alias("page_id"),
        "payload_bytes",
        F.col("digest_so_far").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
