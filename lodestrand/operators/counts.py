"""Counts: alleles by site, reads by position, genotypes by variant."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar
from ..functions.alleles import allele_class
from ..sources.scratch import folder
from .overlap import read_variants


def last_per_position(snps: DataFrame) -> DataFrame:
    """Variants with one at each position: of several, the one of largest snp_idx."""
    rest = [c for c in snps.columns if c not in ("chrom", "pos")]
    last = snps.groupBy("chrom", "pos").agg(F.max_by(F.struct(*rest), "snp_idx").alias("_row"))
    return last.select(*(F.col(c) if c in ("chrom", "pos") else F.col(f"_row.{c}").alias(c) for c in snps.columns))


def class_counts(base: Column, ref: Column, alt: Column) -> list[Column]:
    """ref_n, alt_n and other_n."""
    kind = allele_class(base, ref, alt)
    return [F.count_if(kind == k).alias(f"{k}_n") for k in ("ref", "alt", "other")]


def allele_counts(hits: DataFrame, by: tuple[str, ...] = ("chrom", "site", "ref", "alt")) -> DataFrame:
    """Counts of each class of base at each SNP; a read that covers several counts at each."""
    return hits.where("is_snp").groupBy(*by).agg(*class_counts(F.col("base"), F.col("ref"), F.col("alt")))


def match_totals(hits: DataFrame) -> DataFrame:
    """ref_n, alt_n and other_n over all covered SNPs, and the share of other."""
    totals = hits.where("is_snp").agg(*class_counts(F.col("base"), F.col("ref"), F.col("alt")))
    return totals.withColumn("other_share", F.col("other_n") / F.greatest(F.col("ref_n") + F.col("alt_n") + F.col("other_n"), F.lit(1)))


def usable_hits(hits: DataFrame, read: str = "qname", by: tuple[str, ...] = ()) -> DataFrame:
    """Hits of reads that cover no indel; by: columns within which reads are told apart, as individuals are."""
    return hits.withColumn("_any", F.max(~F.col("is_snp")).over(Window.partitionBy(*by, read))).where(~F.col("_any")).drop("_any")


def one_site_per_read(hits: DataFrame, read: str = "qname", seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """One hit of each read, chosen by hash, so that the choice does not depend on partitions or order.

    The md5 of read, site and seed orders the hits; by names what tells reads of one name apart.
    """
    order = F.md5(F.concat_ws("|", F.col(read).cast("string"), F.col("site").cast("string"), F.lit(str(seed))))
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*by, read).orderBy(order))).where("_n = 1").drop("_n")


def saturated(n: Column, most: int) -> Column:
    """A count that stops at a type's largest value."""
    return F.least(n, F.lit(most))


def start_depth(reads: DataFrame, most: int | None = None, by: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """Reads that start at each position, up to a largest count if one is given."""
    n = F.count("*")
    return reads.groupBy(*by).agg((saturated(n, most) if most is not None else n).alias("n"))


def countable_reads(reads: DataFrame, chroms: DataFrame) -> DataFrame:
    """Reads that counting takes up: inside their chromosome (chroms: chrom, length) and without clipped bases."""
    known = reads.join(F.broadcast(chroms.select("chrom", F.col("length").alias("_length"))), "chrom")  # a row per chromosome
    last = F.col("pos") + cigar.reference_length(F.col("cigar")) - 1
    return known.where((F.col("pos") >= 1) & (last <= F.col("_length")) & cigar.is_whole(F.col("cigar"))).select(*reads.columns)


def count_reads(reads: DataFrame, snps: DataFrame, chroms: DataFrame, genotypes: DataFrame | None = None, by: tuple[str, ...] = ("individual",), read: str = "qname", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Depth (by, chrom, pos, n) and allele counts (by, chrom, site, ref, alt, ref_n, alt_n, other_n) as counting makes them.

    A read past its chromosome's end or with clipped bases counts nowhere, nor
    does one over an indel.  One whose CIGAR has =, X or P counts in depth
    alone.  Of the sites of a read one counts, chosen by hash; with genotypes
    (chrom, pos, individual, hap1, hap2), of those where its individual is
    heterozygous.
    """
    usable = countable_reads(reads, chroms)
    hits = read_variants(usable, snps, counting=True)
    over = hits.where("NOT is_snp").select(*by, read).distinct()
    depth = start_depth(usable.join(over, [*by, read], "left_anti"), by=(*by, "chrom", "pos"))
    hits = hits.join(over, [*by, read], "left_anti")
    if genotypes is not None:
        het = genotypes.where("hap1 <> hap2").select("chrom", F.col("pos").alias("site"), "individual").distinct()
        hits = hits.join(het, ["chrom", "site", "individual"], "left_semi")
    chosen = one_site_per_read(hits, read, seed, by)
    return depth, allele_counts(chosen, (*by, "chrom", "site", "ref", "alt"))


def track_stats(track: DataFrame, value: str = "n", chrom: str = "chrom") -> DataFrame:
    """n, n_null, least, most, total and mean of a track by chromosome, and over all (chrom null)."""
    v = F.col(value)
    return track.rollup(chrom).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.avg(v).alias("mean"))


def genotype_counts(genotypes: DataFrame, by: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """Samples that are homozygous ref, heterozygous and homozygous alt, and the minor allele's count; missing ones count nowhere."""
    dose = F.col("hap1") + F.col("hap2")
    n = genotypes.groupBy(*by).agg(F.count_if(dose == 0).alias("hom_ref"), F.count_if(dose == 1).alias("het"), F.count_if(dose == 2).alias("hom_alt"))
    return n.withColumn("minor_n", F.least(2 * F.col("hom_ref") + F.col("het"), 2 * F.col("hom_alt") + F.col("het")))


def polymorphic(genotypes: DataFrame) -> DataFrame:
    """Positions at which the samples have both alleles: chrom, pos, ref_n, alt_n."""
    alt = F.coalesce(F.col("hap1"), F.lit(0)) + F.coalesce(F.col("hap2"), F.lit(0))
    known = F.col("hap1").isNotNull().cast("int") + F.col("hap2").isNotNull().cast("int")
    n = genotypes.groupBy("chrom", "pos").agg(F.sum(known - alt).alias("ref_n"), F.sum(alt).alias("alt_n"))
    return n.where("ref_n > 0 AND alt_n > 0")


def subset_samples(genotypes: DataFrame, names: list[str], strict: bool = True) -> DataFrame:
    """Genotypes of the named samples; a name given twice counts once, an unknown one is an error, or a warning if not strict."""
    wanted = list(dict.fromkeys(names))
    have = {r[0] for r in genotypes.where(F.col("sample").isin(wanted)).select("sample").distinct().collect()}
    if missing := [n for n in wanted if n not in have]:
        if strict:
            raise ValueError(f"samples not found: {', '.join(missing)}")
        warnings.warn(f"samples not found: {', '.join(missing)}", stacklevel=2)
    return genotypes.where(F.col("sample").isin(wanted))


def combined_counts(as_counts: DataFrame) -> DataFrame:
    """Allele counts summed over individuals."""
    return as_counts.groupBy("chrom", "site").agg(*(F.sum(c).alias(c) for c in ("ref_n", "alt_n", "other_n")))


def dense_report(snps: DataFrame, as_counts: DataFrame, genotypes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """A row per variant, covered or not: counts (0 if none) and the genotype as h1|h2 (NA if unknown).

    With by (individual), a row per variant and each of them that has a row in genotypes or counts at all.
    The counts, of which there is a row a site and individual, are then written once, so that reads are not counted twice.
    """
    at = [*by, "chrom", "pos"]
    n = as_counts.select(*by, "chrom", F.col("site").alias("pos"), "ref_n", "alt_n", "other_n")
    if by:
        path = folder(as_counts.sparkSession, "counts")
        n.write.parquet(path)
        n = as_counts = as_counts.sparkSession.read.schema(n.schema).parquet(path)
        who = as_counts.select(*by) if genotypes is None else as_counts.select(*by).unionByName(genotypes.select(*by))
        everyone = who.distinct().agg(F.collect_set(F.struct(*by)))  # a value for each individual
        snps = snps.withColumn("_who", everyone.scalar()).select(F.explode("_who").alias("_who"), *snps.columns).select("_who.*", *snps.columns)
    out = snps.join(n, at, "left").na.fill(0, ["ref_n", "alt_n", "other_n"])
    if genotypes is None:
        return out.withColumn("genotype", F.lit("NA"))
    own = genotypes.select(*at, F.when(F.col("hap1").isNotNull() & F.col("hap2").isNotNull(), F.concat_ws("|", F.col("hap1").cast("string"), F.col("hap2").cast("string"))).alias("genotype"))
    return out.join(own, at, "left").na.fill("NA", ["genotype"])
