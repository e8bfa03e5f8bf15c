"""Interval joins: reads with variants, regions with points.

Intervals are cut into bins; chromosome and bin are equality keys, so the join
is hashed or sorted and shuffles by (chromosome, bin) and never by chromosome alone.
A point lies in one bin, so no pair is found twice.  Variants of a bin are kept as
lists, so a read meets a row a bin, and its variants are a slice of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles, cigar

#: Positions of a bin: of regions, and of aligned blocks, which are as long as a read at most.
BIN, READ_BIN = 1_024, 128


def interval_points(intervals: DataFrame, points: DataFrame, start: str = "start", stop: str = "stop", pos: str = "pos", chrom: str = "chrom", width: int = BIN, how: str = "inner") -> DataFrame:
    """Every point in every interval that holds it; columns of both, those of intervals first.

    Null bounds or positions match nothing; how is inner or left.
    """
    low, high = F.floor(F.col(start) / width), F.floor(F.col(stop) / width)
    left = intervals.withColumn("_bin", F.explode_outer(F.when(F.col(stop) >= F.col(start), F.sequence(low, high))))
    right = points.select(*(F.col(c).alias(f"_p_{c}") for c in points.columns), F.floor(F.col(pos) / width).alias("_p_bin"))
    on = (F.col(chrom) == F.col(f"_p_{chrom}")) & (F.col("_bin") == F.col("_p_bin")) & F.col(f"_p_{pos}").between(F.col(start), F.col(stop))
    extra = [F.col(f"_p_{c}").alias(c) for c in points.columns if c != chrom]
    return left.join(right, on, how).select(*intervals.columns, *extra)


def interval_intervals(a: DataFrame, b: DataFrame, start: str = "start", stop: str = "stop", chrom: str = "chrom", width: int = BIN, suffix: str = "_b") -> DataFrame:
    """Every two intervals that overlap, each pair once: where both begin to share bins."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(e / width)))
    left = a.withColumn("_bin", bins(F.col(start), F.col(stop)))
    right = b.select(*(F.col(c).alias(c + suffix) for c in b.columns)).withColumn("_bin_b", bins(F.col(start + suffix), F.col(stop + suffix)))
    on = (F.col(chrom) == F.col(chrom + suffix)) & (F.col("_bin") == F.col("_bin_b")) & (F.col(start) <= F.col(stop + suffix)) & (F.col(start + suffix) <= F.col(stop)) & (F.col("_bin") == F.floor(F.greatest(start, start + suffix) / width))
    return left.join(right, on).drop("_bin", "_bin_b")


def variant_bins(snps: DataFrame, counting: bool = False, width: int = READ_BIN) -> DataFrame:
    """A row for each bin that holds variants: chrom, _bin, _all and _snps (lists by position), and _upto and _snps_upto.

    The latter say how many members of the lists lie before each place of the
    bin, so that those of a stretch are a slice.  What kind a variant is is
    found once here, and not for each read that covers it.
    """
    ref, alt = F.col("allele1"), F.col("allele2")
    kind = alleles.is_length_changing(ref, alt) if counting else ~alleles.is_snp(ref, alt)
    at = snps.where("pos IS NOT NULL").select("chrom", F.floor(F.col("pos") / width).alias("_bin"), F.struct(F.col("pos").alias("site"), "snp_idx", ref.alias("ref"), alt.alias("alt"), (~kind).alias("is_snp")).alias("_v"))
    lists = at.groupBy("chrom", "_bin").agg(F.sort_array(F.collect_list("_v")).alias("_all")).withColumn("_snps", F.filter("_all", lambda v: v["is_snp"]))
    upto = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width)), lambda i: F.size(F.filter(c, lambda v: v["site"] - F.col("_bin") * width < i)))
    return lists.select("chrom", "_bin", "_all", "_snps", upto("_all").alias("_upto"), upto("_snps").alias("_snps_upto"))


def in_bins(stretches: DataFrame, variants: DataFrame, how: str = "inner", width: int = READ_BIN) -> DataFrame:
    """A row for each stretch (chrom, start, stop) and bin that it touches, with the bin's lists and _low and _high: the places there from and before which it lies."""
    low, high = F.floor(F.col("start") / width), F.floor(F.col("stop") / width)
    cut = stretches.withColumn("_bin", F.explode_outer(F.when(F.col("stop") >= F.col("start"), F.sequence(low, high))))
    first = F.col("_bin") * width
    at = lambda c: c.cast("int")
    return cut.join(variants, ["chrom", "_bin"], how).withColumns({"_low": at(F.greatest(F.col("start") - first, F.lit(0))), "_high": at(F.least(F.col("stop") - first + 1, F.lit(width)))})


def count_within(upto: str) -> Column:
    """How many members of a list lie in a stretch, given what in_bins() makes."""
    return F.get(F.col(upto), F.col("_high")) - F.get(F.col(upto), F.col("_low"))


def members_within(members: str, upto: str) -> Column:
    """Those members."""
    return F.slice(members, F.get(F.col(upto), F.col("_low")) + 1, count_within(upto))


def read_variants(reads: DataFrame, snps: DataFrame, counting: bool = False) -> DataFrame:
    """A row for each variant that a read covers: the read's columns, snp_idx, site, ref, alt, read_pos, is_snp, base.

    SNPs count in aligned blocks alone; indels count inside deletions too.
    Skipped, clipped, inserted and padded stretches meet nothing.
    counting: the dialect of read counting, where = and X are not known and
    deletions meet nothing, and an indel is what changes a length.
    """
    at = reads.select(*reads.columns, F.inline(cigar.blocks(F.col("pos"), F.col("cigar"), deleted=not counting)))
    if counting:
        at = at.where((F.col("op") == "M") & cigar.is_countable(F.col("cigar")))
    here = in_bins(at, variant_bins(snps, counting)).where(count_within("_upto") > 0)
    hits = here.select(*reads.columns, "op", "start", "read_start", F.inline(members_within("_all", "_upto"))).where("op <> 'D' OR NOT is_snp")
    read_pos = F.col("read_start") + F.when(F.col("op") == "D", 0).otherwise(F.col("site") - F.col("start"))
    return hits.select(*reads.columns, "snp_idx", "site", "ref", "alt", read_pos.alias("read_pos"), "is_snp", "op").withColumn("base", F.when(F.col("op") != "D", F.substr("seq", F.col("read_pos").cast("int"), F.lit(1)))).drop("op")


def site_counts(stretches: DataFrame, variants: DataFrame, most: int | None = None, how: str = "inner") -> DataFrame:
    """stretches (blocks of reads: chrom, start, stop, read_start, op) by bin, with n_snps, n_indels and sites (read_pos, ref, alt, site).

    Sites are left out where there are more than most or an indel is covered,
    so that what goes on from here is bounded by the reads.
    """
    here = in_bins(stretches, variants, how)
    deleted = F.col("op") == "D"
    n = F.coalesce(F.when(deleted, 0).otherwise(count_within("_snps_upto")), F.lit(0)).cast("long")
    indels = F.coalesce(count_within("_upto") - count_within("_snps_upto"), F.lit(0)).cast("long")
    fit = (n > 0) & ((n <= most) & (indels == 0) if most is not None else F.lit(True))
    site = lambda v: F.struct((F.col("read_start") + v["site"] - F.col("start")).alias("read_pos"), v["ref"].alias("ref"), v["alt"].alias("alt"), v["site"].alias("site"))
    return here.select(*stretches.columns, n.alias("n_snps"), indels.alias("n_indels"), F.when(fit, F.transform(members_within("_snps", "_snps_upto"), site)).alias("sites"))
