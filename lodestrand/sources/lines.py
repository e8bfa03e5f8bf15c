"""Lines of text files with their place: which file, which split of it, which line.

Numbers of lines come from the splits: each split tells how many lines it has,
sums over the splits of a file say where each begins, and no file is numbered
by one task.  Text goes through Spark's reader; block gzip, of which Spark
would give a file to one task, is entered at block boundaries instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.types import StructType

from . import bgzf, streams
from .parts import PartsWriter

#: Bytes of a block gzip file for each split; inflated bytes that are cut into lines at once.
SPLIT_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
#: Splits whose table is broadcast, at most.
BROADCAST_SPLITS = 200_000


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, start (of the split), i (an ascending number of no further meaning) and value of each line, by Spark's text source."""
    rows = spark.read.text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), "value")


def _own_lines(f: pa.NativeFile, size: int, begin: int, end: int) -> Iterator[list[bytes]]:
    """Lines of a block gzip file that begin after the first byte of a split's first block, up to the first byte of the next split's.

    A line that begins with a split's first byte belongs to the split before, which alone
    knows that one begins there; so every line but the first of a split is known by the end of another.
    """
    first = bgzf.next_block(f, begin, size) if begin else 0
    stop = bgzf.next_block(f, end, size) if end < size else size
    if first >= stop and begin:
        return
    rest, skipping, over, out, held = b"", begin > 0, False, [], 0
    for at, data in bgzf.blocks(f, first, size):
        if at >= stop and data:
            if skipping:  # no line begins in this split
                return
            over = True
        *lines, rest = (rest + data).split(b"\n")
        if skipping and lines:
            lines, skipping = lines[1:], False
        if over:  # what goes on from before, or begins with the first byte here, is the last
            if lines:
                yield out + lines[:1]
                return
            continue
        out += lines
        held += len(data)
        if held >= BATCH_BYTES:
            yield out
            out, held = [], 0
    if rest and not skipping:
        out.append(rest)
    if out:
        yield out


def block_lines(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, start, i (from 0 in each split) and value of each line of files of block gzip, many tasks a file.

    Other files, gzip or not, whatever they are called, are a task each.  Files are opened by pyarrow.
    """
    found = spark.read.format("binaryFile").load(paths).select("path", "length")
    splits = found.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str, start: int, i: int, lines: list[bytes]) -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(i, i + n), pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())], names=["file", "start", "i", "value"])

        for b in batches:
            for path, start in zip(*(b.column(c).to_pylist() for c in ("path", "start")), strict=True):
                i = 0
                with bgzf.open_file(path) as f:
                    if bgzf.block_size(f.read(bgzf.MOST)) is not None:
                        for lines in _own_lines(f, f.size(), start, start + split_bytes):
                            if lines:
                                yield rows(path, start, i, lines)
                                i += len(lines)
                        continue
                if start == 0:
                    rest = b""
                    for piece in streams.pieces(path):
                        *lines, rest = (rest + piece).split(b"\n")
                        if lines:
                            yield rows(path, start, i, lines)
                            i += len(lines)
                    if rest:
                        yield rows(path, start, i, [rest])

    tasks = max(1, splits.count())
    return splits.repartition(tasks, "path", "start").mapInArrow(run, "file string, start long, i long, value string")


def numbered(lines: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """lines (text_lines or block_lines, no row of which is left out) with line: its number, from 0, among those of by.

    by: what lines are counted through; files of one value follow each other by name.
    """
    splits = lines.groupBy(*by, *({"file", "start"} - set(by))).agg(F.min("i").alias("_first"), F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "start", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    if begins.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        begins = F.broadcast(begins)  # a row per split
    return lines.join(begins, ["file", "start"]).withColumn("line", F.col("i") - F.col("_first") + F.col("_before")).drop("_first", "_before")


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n of the lines of each file (of those that are here: others may have been left out).

    Splits before the one that the n-th lies in are taken whole; only that one's lines are numbered.
    """
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(F.col("_before") < n)
    if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)  # a row per split
    near = lines.join(splits, ["file", "start"])
    whole = near.where(F.col("_before") + F.col("_n") <= n)
    cut = near.where(F.col("_before") + F.col("_n") > n).withColumn("_k", F.row_number().over(Window.partitionBy("file", "start").orderBy("i"))).where(F.col("_before") + F.col("_k") <= n).drop("_k")
    return whole.unionByName(cut).drop("_n", "_before")


class BlockTextWriter(PartsWriter):
    """Lines as block gzip, a file for each task; each begins with the header."""

    ending = ".txt.gz"

    def __init__(self, path: str, header: str, overwrite: bool):
        super().__init__(path, overwrite)
        self.header = header

    def put(self, out: pa.NativeFile, batches: Iterator[pa.RecordBatch]) -> tuple[int, dict[str, bytes]]:
        held, rows = bytearray(f"{self.header}\n".encode() if self.header else b""), 0
        for b in batches:
            for line in b.column("value").to_pylist():
                held += (line or "").encode() + b"\n"
                if len(held) >= bgzf.FILL:
                    out.write(bgzf.deflated(bytes(held[: bgzf.FILL])))
                    del held[: bgzf.FILL]
            rows += b.num_rows
        while held:
            out.write(bgzf.deflated(bytes(held[: bgzf.FILL])))
            del held[: bgzf.FILL]
        out.write(bgzf.END)
        return rows, {}


class BlockTextSource(DataSource):
    """df.write.format("blocktext"): the column value as lines of block gzip files; option header."""

    @classmethod
    def name(cls) -> str:
        return "blocktext"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BlockTextWriter(self.options["path"], self.options.get("header", ""), overwrite)


def write_blocks(lines: DataFrame, path: str, header: str = "", mode: str = "append") -> None:
    """Lines (value) as files of block gzip, which block_lines() reads in splits."""
    lines.sparkSession.dataSource.register(BlockTextSource)
    lines.select("value").write.format("blocktext").option("header", header).mode(mode).save(path)
