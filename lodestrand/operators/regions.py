"""Target regions: windows about variants, and what lies in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coords, seq
from .overlap import interval_points


def window_sums_binned(depth: DataFrame, centres: DataFrame, half: int, value: str = "n", width: int = 1 << 16) -> DataFrame:
    """centres (chrom, pos, ...) with region_n: the depth from half before to half after each, by a RANGE frame.

    Depth rows and centres with no weight are sorted together, so nothing is
    joined; the unit of work is a bin of a chromosome, and depth that reaches
    into a neighbouring bin's windows goes to both.
    """
    rest = [c for c in centres.columns if c not in ("chrom", "pos")]
    at = centres.select("chrom", F.floor(F.col("pos") / width).alias("_bin"), "pos", F.lit(0).cast("long").alias("_n"), F.struct(F.lit(1).alias("_c"), *rest).alias("_row"))
    spread = F.explode(F.sequence(F.floor((F.col("pos") - half) / width), F.floor((F.col("pos") + half) / width)))
    tracks = depth.select("chrom", spread.alias("_bin"), "pos", F.col(value).cast("long").alias("_n"), F.lit(None).cast(at.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("chrom", "_bin").orderBy("pos").rangeBetween(-half, half)
    both = tracks.unionByName(at).withColumn("region_n", F.sum("_n").over(w)).where("_row IS NOT NULL")
    return both.select("chrom", "pos", *(F.col(f"_row.{c}").alias(c) for c in rest), "region_n")


def target_regions(snps: DataFrame, genotype_counts: DataFrame, as_counts: DataFrame, depth: DataFrame, size: int, min_as: int = 10, min_reads: int = 100, min_het: int = 1, min_minor: int = 1) -> DataFrame:
    """Regions of size about variants that have enough of everything: chrom, pos, end_pos, name, ref, alt, start, stop and the counts.

    It begins with variants, so positions that are none cannot come in.  size is even.
    """
    if size % 2:
        raise ValueError("the region size must be even")
    half = size // 2
    as_n = as_counts.groupBy("chrom", F.col("site").alias("pos")).agg(F.sum(F.col("ref_n") + F.col("alt_n")).alias("as_n"))
    enough = snps.join(genotype_counts.select("chrom", "pos", "het", "minor_n"), ["chrom", "pos"]).where((F.col("het") >= min_het) & (F.col("minor_n") >= min_minor))
    enough = enough.join(as_n, ["chrom", "pos"], "left").withColumn("as_n", F.coalesce("as_n", F.lit(0))).where(F.col("as_n") >= min_as)
    with_reads = window_sums_binned(depth, enough, half).where(F.col("region_n") >= min_reads)
    start = F.greatest(F.col("pos") - half, F.lit(1))
    return with_reads.select("chrom", "pos", (F.col("pos") + 1).alias("end_pos"), F.concat_ws(".", "chrom", (start + 1).cast("string")).alias("name"), F.col("allele1").alias("ref"), F.col("allele2").alias("alt"), start.alias("start"), (F.col("pos") + half).alias("stop"), "het", "minor_n", "as_n", "region_n")


def points_in_regions(regions: DataFrame, points: DataFrame, key: str = "region_id") -> DataFrame:
    """Each point of each region, once, whose parts are arrays starts and stops."""
    parts = regions.select(key, "chrom", F.explode(F.arrays_zip("starts", "stops")).alias("_p")).select(key, "chrom", F.col("_p.starts").alias("_start"), F.col("_p.stops").alias("_stop"))
    return interval_points(parts, points, "_start", "_stop", "pos").drop("_start", "_stop").distinct()


def region_sums(regions: DataFrame, depth: DataFrame, key: str = "region_id", value: str = "n") -> DataFrame:
    """key and region_n of each region: the depth in all its parts, 0 if none."""
    parts = regions.select(key, "chrom", F.explode(F.arrays_zip("starts", "stops")).alias("_p")).select(key, "chrom", F.col("_p.starts").alias("_start"), F.col("_p.stops").alias("_stop"))
    hit = interval_points(parts, depth.select("chrom", "pos", F.col(value).alias("_n")), "_start", "_stop", "pos")
    sums = hit.groupBy(key).agg(F.sum("_n").alias("region_n"))
    return regions.select(key).join(sums, key, "left").na.fill(0, ["region_n"])


def region_bases(regions: DataFrame, chunks: DataFrame, key: str = "region_id", chunk: int = 32) -> DataFrame:
    """key, gc, at and gc_fraction of each region from sequence chunks (chrom, chunk_start, bases) of equal length.

    Each part asks for its chunks by number, so the join is on equality.
    """
    parts = regions.select(key, "chrom", F.explode(F.arrays_zip("starts", "stops")).alias("_p")).select(key, "chrom", F.col("_p.starts").alias("_s"), F.col("_p.stops").alias("_e"))
    asked = parts.withColumn("chunk_start", F.explode(F.transform(F.sequence(F.floor((F.col("_s") - 1) / chunk), F.floor((F.col("_e") - 1) / chunk)), lambda i: i * chunk + 1)))
    got = asked.join(chunks, ["chrom", "chunk_start"])
    first = F.greatest(F.col("_s") - F.col("chunk_start"), F.lit(0))
    last = F.least(F.col("_e") - F.col("chunk_start"), F.length("bases") - 1)
    cut = F.substr("bases", (first + 1).cast("int"), (last - first + 1).cast("int"))
    n = got.groupBy(key).agg(F.sum(seq.count_bases(cut, "GC")).alias("gc"), F.sum(seq.count_bases(cut, "AT")).alias("at"))
    return n.withColumn("gc_fraction", F.when(F.col("gc") + F.col("at") > 0, F.col("gc") / (F.col("gc") + F.col("at"))))


def sorted_by_place(rows: DataFrame, chroms: DataFrame, start: str = "start", strand: str | None = None) -> DataFrame:
    """rows in the order of their chromosomes' numbers (chroms: chrom, idnum), of strand if named, and of start; a range-partitioned sort."""
    known = rows.join(F.broadcast(chroms.select("chrom", F.col("idnum").alias("_id"))), "chrom", "left")  # a row per chromosome
    return known.orderBy(coords.key(F.col("_id"), F.col(start), F.col(strand) if strand else None)).drop("_id")
