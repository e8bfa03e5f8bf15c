"""FASTA files: read into chunks of equal length, and written."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import wrap


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, str | None, Iterator[str]]]:
    """Of lines (file, block, value) in order: file, block, number within the block, name (None: of a sequence begun before) and lines of each sequence."""
    lines = ((f, k, v) for b in batches for f, k, v in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value").to_pylist(), strict=True))
    for (file, block), own in itertools.groupby(lines, key=lambda x: x[:2]):
        held: list[str | None] = [None]

        def parts(own=own, held=held) -> Iterator[tuple[int, str | None, str]]:
            i = 0
            for _, _, v in own:
                if v.startswith(">"):
                    i += 1
                    held[0] = (v[1:].split() or [""])[0]
                    yield i, held[0], ""
                else:
                    yield i, held[0], "".join(v.split())

        for (i, name), some in itertools.groupby(parts(), key=lambda x: x[:2]):
            yield file, block, i, name, (x[2] for x in some)


def read_fasta(spark: SparkSession, paths: str | list[str], chunk: int = 10_000, chroms: DataFrame | None = None) -> DataFrame:
    """chrom, chunk_start (from 1) and bases; with chroms (chrom, length) a sequence of another length is an error.

    Files are read by lines in as many splits as Spark cuts them into.  A first
    pass measures what each split has of each sequence; so the second knows
    where its lines lie, and pieces of a chunk from two splits are put together.
    White space is dropped.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").where("value <> ''")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, i, name, some in _sequences(batches):
            yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([block], pa.int64()), "i": pa.array([i], pa.int64()), "name": pa.array([name], pa.string()), "n": pa.array([sum(map(len, some))], pa.int64())})

    begun: dict[tuple[str, int], tuple[str | None, int]] = {}
    total: dict[str | None, int] = {}
    last, name, at = None, None, 0
    for r in sorted(lines.mapInArrow(measure, "file string, block long, i long, name string, n long").collect(), key=lambda r: (r.file, r.block, r.i)):  # a row per split and sequence
        if r.file != last:
            last, name, at = r.file, None, 0
        begun.setdefault((r.file, r.block), (name, at))
        name, at = (r.name, 0) if r.name is not None else (name, at)
        at += r.n
        total[name] = total.get(name, 0) + r.n
    if chroms is not None:
        wrong = [r.chrom for r in chroms.select("chrom", "length").collect() if total.get(r.chrom, r.length) != r.length]  # a row per chromosome
        if wrong:
            raise ValueError(f"sequence is not as long as its chromosome: {', '.join(wrong)}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, _, own, some in _sequences(batches):
            name, at = (own, 0) if own is not None else begun.get((file, block), (None, 0))
            held, size = [], 0
            for line in itertools.chain(some, [None]):
                if line is not None:
                    held.append(line)
                    size += len(line)
                if size >= 64 * chunk or line is None and size:
                    whole, starts = "".join(held), []
                    first = at // chunk * chunk
                    edges = [max(x, at) for x in range(first, at + size, chunk)] + [at + size]
                    starts = [x // chunk * chunk + 1 for x in edges[:-1]]
                    yield pa.RecordBatch.from_pydict({"chrom": [name] * len(starts), "chunk_start": pa.array(starts, pa.int64()), "at": pa.array(edges[:-1], pa.int64()), "bases": [whole[a - at : z - at] for a, z in itertools.pairwise(edges)]})
                    at, held, size = at + size, [], 0

    pieces = lines.mapInArrow(cut, "chrom string, chunk_start long, at long, bases string").where("chrom IS NOT NULL")
    together = pieces.groupBy("chrom", "chunk_start").agg(F.sort_array(F.collect_list(F.struct("at", "bases"))).alias("p"))  # a chunk at most
    return together.select("chrom", "chunk_start", F.array_join(F.transform("p", lambda x: x["bases"]), "").alias("bases"))


def fasta_lines(chunks: DataFrame, width: int = 70) -> DataFrame:
    """value: the lines of a FASTA file in order: the name of each chromosome, then its bases, width letters a line."""
    return _lines(chunks, width).orderBy("chrom", "line").select("value")


def write_fasta(chunks: DataFrame, path: str, width: int = 70) -> None:
    """A folder with a FASTA file for each chromosome (read path/*): a task streams the sorted lines of one."""
    lines = _lines(chunks, width).repartition("chrom").sortWithinPartitions("chrom", "line")
    lines.select("chrom", "value").write.partitionBy("chrom").text(path)


def _lines(chunks: DataFrame, width: int) -> DataFrame:
    """chrom, line (-1 for the name) and value; chunks are cut into parts of lines, which are put together line by line, so no chromosome is gathered."""
    first, last = F.floor((F.col("chunk_start") - 1) / width), F.floor((F.col("chunk_start") + F.length("bases") - 2) / width)
    each = chunks.where("bases <> ''").withColumn("line", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("line") * width + 1, F.col("chunk_start"))
    stop = F.least((F.col("line") + 1) * width, F.col("chunk_start") + F.length("bases") - 1)
    parts = each.select("chrom", "line", start.alias("at"), F.substr("bases", (start - F.col("chunk_start") + 1).cast("int"), (stop - start + 1).cast("int")).alias("part"))
    lines = parts.groupBy("chrom", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("value"))
    heads = chunks.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("line"), F.concat(F.lit(">"), "chrom").alias("value"))
    return heads.unionByName(lines)


def fasta_text(chunks: DataFrame, width: int = 70) -> DataFrame:
    """value: the record of each chromosome, in lines of width letters, for sequences that fit one row; fasta_lines() takes any."""
    whole = chunks.groupBy("chrom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_start", "bases"))), lambda c: c["bases"]), "").alias("seq"))
    return whole.select("chrom", F.concat(F.lit(">"), F.col("chrom"), F.lit("\n"), wrap(F.col("seq"), width)).alias("value"))


def composition(chunks: DataFrame) -> DataFrame:
    """Letters of each kind by chromosome: chrom, base, n."""
    each = chunks.select("chrom", F.explode(F.split(F.upper("bases"), "")).alias("base")).where("base <> ''")
    return each.groupBy("chrom", "base").agg(F.count("*").alias("n"))


