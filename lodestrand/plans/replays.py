"""Queries that replay a table as a stream, in order of place, and must give what the batch queries give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder
from ..streaming import duplicates
from . import views
from .queries import SQL, query


def in_order_of_place(reads: DataFrame, label: str) -> str:
    """A folder of files that follow each other by chromosome and position, written one after another, and then an end mark."""
    spark, path = reads.sparkSession, folder(reads.sparkSession, label)
    for chrom in [r[0] for r in views.chromosomes(spark).orderBy("chrom").collect()]:  # five of them
        reads.where(F.col("chrom") == chrom).repartitionByRange(4, "pos").sortWithinPartitions("pos").write.mode("append").parquet(path)
    duplicates.end_mark(spark, reads.schema).write.mode("append").parquet(path)
    return path


def _replay(reads: DataFrame, label: str, keep) -> DataFrame:
    spark = reads.sparkSession
    source = in_order_of_place(reads, label)
    chroms = views.chromosomes(spark).orderBy("chrom")
    return duplicates.replayed(spark, source, reads.schema, folder(spark, f"{label}-kept"), folder(spark, f"{label}-checkpoint"), lambda s: keep(s, chroms, delay=30_000), files=4)


@query(SQL["rmdup_pairs"])
def rmdup_pairs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair of those at the same two positions, from a stream of all reads."""
    return _replay(views.pairs(spark, sf_dir), "pair-stream", duplicates.dedup_pairs_stream).select("qname", "mate", "chrom", "pos")


@query(SQL["rmdup_single"])
def rmdup_single_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read of each position and strand, from a stream of all reads."""
    return _replay(views.reads(spark, sf_dir), "read-stream", duplicates.dedup_single_stream).select("qname", "chrom", "pos", "flag")
