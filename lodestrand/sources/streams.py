"""Files that Spark's text source does not take as they are: read as streams, a task for each."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of a gzip member (a fixed value), and bytes read at a time.
GZIP, READ_BYTES = b"\x1f\x8b", 1 << 20


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path of each file, dealt out one to a task; nothing of them is read."""
    found = spark.read.format("binaryFile").load(paths).select("path")
    return found.repartition(max(1, found.count()), "path")


def pieces(path: str) -> Iterator[bytes]:
    """The bytes of a file as it comes, gzip members (of which BGZF files are made) inflated, whatever it is called."""
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    fs, at = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(at, compression=None) as stream:
        data = stream.read(READ_BYTES)
        if not data.startswith(GZIP):
            while data:
                yield data
                data = stream.read(READ_BYTES)
            return
        d = zlib.decompressobj(31)
        while data:
            out = d.decompress(data, READ_BYTES)  # what is inflated is bounded too, however small it was made
            if out:
                yield out
            if d.eof:
                data = d.unused_data or stream.read(READ_BYTES)
                d = zlib.decompressobj(31) if data else d
            elif d.unconsumed_tail:
                data = d.unconsumed_tail
            elif len(out) < READ_BYTES:
                data = stream.read(READ_BYTES)
                if not data:
                    raise ValueError(f"{path} ends within a gzip member")
            else:  # the output was full: there may be more inside
                data = stream.read(READ_BYTES)
                if not data:
                    while out := d.decompress(b"", READ_BYTES):
                        yield out
                    if not d.eof:
                        raise ValueError(f"{path} ends within a gzip member")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line (from 1) and value of each line of text files, gzip or not by their first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rest, n = b"", 0
                for piece in pieces(path):
                    *lines, rest = (rest + piece).split(b"\n")
                    if lines:
                        yield pa.RecordBatch.from_pydict({"path": [path] * len(lines), "line": pa.array(range(n + 1, n + len(lines) + 1), pa.int64()), "value": [x.decode() for x in lines]})
                        n += len(lines)
                if rest:
                    yield pa.RecordBatch.from_pydict({"path": [path], "line": pa.array([n + 1], pa.int64()), "value": [rest.decode()]})

    return files(spark, paths).mapInArrow(run, "path string, line long, value string")


def count_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and lines of each file that has a line; line ends are counted in the bytes, no line is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                n, last = 0, b"\n"
                for piece in pieces(path):
                    n, last = n + piece.count(b"\n"), piece[-1:]
                n += last != b"\n"
                if n:
                    yield pa.RecordBatch.from_pydict({"path": [path], "lines": pa.array([n], pa.int64())})

    return files(spark, paths).mapInArrow(run, "path string, lines long")
