"""WARC archives: a writer, and a sequential reader.

Each record is one gzip member.  The reader takes an archive as a stream of
pieces, inflates it bit by bit, frames each record by its Content-Length and
verifies the digests of block and payload; an archive is never held whole.

Archives go to the shared folder through pyarrow's file systems, under names
that no other attempt of a task uses; a written manifest names those of the
attempts that counted, so a lost executor or a second attempt leaves files that
nobody reads, and never half a record.

Defined results: a null html is an empty payload; payloads under min_bytes are
all responses; among equal larger payloads the rows with the smallest page_id
(all of them, should they repeat) are responses and the others revisits; a null
page_id is never the smallest unless there is no other; a null url is written
as the record's own name; very long pages are whole records; an empty table
gives an archive-less manifest and no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, configure, hadoop_path, scratch, written

NAME = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a writer begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes that the reader asks a stream for at a time.
READ_BYTES = 1 << 18
DATE = "2000-01-01T00:00:00Z"


def _name(page_id: int | None) -> str:
    return f"<{NAME}{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    text = name.strip("<>").removeprefix(NAME)
    return None if text == "null" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A whole WARC record, not yet compressed.  A revisit's block has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else _name(page_id).strip('<>')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Inflated:
    """A stream of gzip members, read member by member."""

    def __init__(self, stream):
        self.stream = stream
        self.rest = b""

    def _more(self) -> bool:
        self.rest = self.rest or self.stream.read(READ_BYTES)
        return bool(self.rest)

    def members(self) -> Iterator[Iterator[bytes]]:
        """The inflated pieces of each member; a member must be used up before the next."""
        while self._more():
            yield self._pieces()

    def _pieces(self) -> Iterator[bytes]:
        d = zlib.decompressobj(31)
        while not d.eof:
            if not self._more():
                raise ValueError("an archive ends within a gzip member")
            out = d.decompress(self.rest, READ_BYTES * 4)
            self.rest = d.unused_data if d.eof else d.unconsumed_tail
            if out:
                yield out


def _head(pieces: Iterator[bytes], buffer: bytearray) -> list[str]:
    """Lines up to the first empty one, taken off the buffer."""
    while (end := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record has no end of its header")
        buffer += piece
    lines = bytes(buffer[:end]).decode().split("\r\n")
    del buffer[: end + 4]
    return lines


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(pieces: Iterator[bytes]) -> dict:
    """A record from the inflated pieces of its member; raises where framing or a digest is wrong."""
    buffer = bytearray()
    version, *rest = _head(pieces, buffer)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = _fields(rest)
    size = int(fields["content-length"])
    for piece in pieces:
        buffer += piece
    if len(buffer) != size + 4 or buffer[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']}: the block is not {size} bytes")
    block = bytes(buffer[:size])
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["warc-block-digest"]:
        raise ValueError(f"{fields['warc-record-id']}: the block digest differs")
    inner = bytearray(block)
    http = _fields(_head(iter(()), inner)[1:])
    payload = bytes(inner)
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != int(http["content-length"]) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{fields['warc-record-id']}: the payload differs from its length or digest")
    elif payload or fields.get("warc-profile") != PROFILE:
        raise ValueError(f"{fields['warc-record-id']}: not a known kind of revisit")
    refers = fields.get("warc-refers-to")
    return {"page_id": _page(fields["warc-record-id"]), "url": unquote(fields["warc-target-uri"]), "payload": payload if kind == "response" else None, "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": _page(refers) if refers else None}


def with_originals(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to and revisit.

    Groups are counted from narrow rows with partial sums.  Whole pages stay
    where they are if the groups of two or more are few enough to be sent to
    them; else they are joined by a shuffle, where Spark may split a large group.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"))
    light = pages.select("page_id", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).alias("size")).where(F.col("size") >= min_bytes)
    groups = light.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = written(groups, "repeated-payloads")
    joined = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "payload_digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "html", "payload_digest", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each page (page_id, url, html); gives the manifest: path, records.

    folder: one that pyarrow can write to from every executor, named as Spark
    resolves it (against the default file system if it has no scheme); a new one
    in the shared folder if not given.
    """
    spark = configure(pages.sparkSession)
    at, _ = hadoop_path(spark, folder or scratch(spark, "warc"))
    uri = at.toUri().toString()
    uri = f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        out, count, path = None, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                if out is None:
                    path, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                out.write(member(record(r["page_id"], r["url"], r["html"], r["payload_digest"], r["refers_to"], r["revisit"])))
                count += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(with_originals(pages, min_bytes).mapInArrow(run, "path string, records long"), "warc-manifest").withColumn("folder", F.lit(uri))


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record of the archives that a manifest (path, folder) names.

    payload: whether the payloads come along (null for revisits).
    """
    configure(manifest.sparkSession)
    fields = [("page_id", T.LongType()), ("url", T.StringType()), ("payload", T.BinaryType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields if payload or n != "payload"])
    kinds = pa.schema([(n, {"payload": pa.binary(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}.get(n, pa.string())) for n in schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["folder"])
                rows, size, count = [], 0, 0
                with fs.open_input_stream(row["path"], compression=None) as stream:
                    for pieces in Inflated(stream).members():
                        got = parse(pieces)
                        count += 1
                        rows.append({n: got[n] for n in schema.names})
                        size += len(got["payload"] or b"") if payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, size = [], 0
                if count != row["records"]:
                    raise ValueError(f"{row['path']} has {count} records, not {row['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = max(1, manifest.count())
    return manifest.select("path", "records", "folder").repartition(files, F.xxhash64("path")).mapInArrow(run, schema)


def described(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back, without their payloads."""
    return read_archives(write_archives(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
