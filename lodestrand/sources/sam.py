"""Aligned reads as SAM text, split by the JVM.  BAM files are in `bam`, whose names are known here too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import BASES, COLUMNS, OPERATIONS, BamSource, parse_bam, read_bam, with_mate_chrom, write_bam

__all__ = ["BASES", "COLUMNS", "OPERATIONS", "BamSource", "on_chromosome", "parse_bam", "read_bam", "read_sam", "sam_text", "with_mate_chrom", "write_bam"]


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reads of SAM files, with mate_chrom; header lines and optional fields are passed over."""
    p = F.split("value", "\t")
    rows = spark.read.text(paths).where("NOT rlike(value, '^@[A-Z][A-Z](\t|$)') AND value <> ''")
    cast = {"string": lambda c: c, "int": lambda c: c.cast("int"), "bigint": lambda c: c.cast("long")}
    out = rows.select(*(cast[kind](p[i]).alias(name) for i, (name, kind) in enumerate(x.split() for x in COLUMNS.split(", "))))
    return with_mate_chrom(out)


def sam_text(reads: DataFrame) -> DataFrame:
    """value: a SAM line for each read."""
    return reads.select(F.concat_ws("\t", *(F.col(c.split()[0]).cast("string") for c in COLUMNS.split(", "))).alias("value"))


def on_chromosome(reads: DataFrame, chrom: str) -> DataFrame:
    """Reads of a chromosome whose name may come with or without chr."""
    bare = chrom.removeprefix("chr")
    return reads.where(F.col("chrom").isin(bare, f"chr{bare}"))
