"""Verdicts on reads whose versions were aligned again, and removal of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alleles import decode_name
from .classify import FIRST, PAIRED, PROPER, SECONDARY, SUPPLEMENTARY, UNMAPPED, duplicate_disposition, has, is_plain_single


def remap_verdict(to_remap: DataFrame, remapped: DataFrame, check_chrom: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """to_remap (a row per read: qname, chrom, pos, cigar, ...) with a verdict for its name:
    keep, missing, poisoned, wrong_place, incomplete or cigar_changed.

    A name is kept if each of its versions came back to the place it left, none
    with a secondary or supplementary record, and the CIGARs are what they were.
    A version of a pair must come back as a proper pair; its left read (the
    first one, where both begin together) tells whether it is in place.
    remapped: name (as encoded), flag, chrom, pos, mate_pos, cigar.
    by: columns of both within which names are told apart, as individuals are.
    """
    at = decode_name(F.col("name"))
    rows = remapped.select(*by, at.alias("d"), "flag", F.col("chrom").alias("new_chrom"), "pos", "mate_pos", "cigar").select(*by, "d.*", "flag", "new_chrom", "pos", "mate_pos", "cigar")
    own = to_remap.groupBy(*by, "qname").agg(F.array_sort(F.collect_set("cigar")).alias("cigars"), F.min("chrom").alias("own_chrom"), F.count("*").alias("n_reads"))
    single = F.col("exp_pos2").isNull()
    left = single | (F.col("pos") < F.col("mate_pos")) | ((F.col("pos") == F.col("mate_pos")) & has(FIRST))
    here = (F.col("pos") == F.col("exp_pos1")) & (single | (F.col("mate_pos") == F.col("exp_pos2")))
    rows = rows.join(own.select(*by, F.col("qname").alias("orig_name"), "own_chrom"), [*by, "orig_name"])
    right = F.coalesce(here & ~has(UNMAPPED), F.lit(False)) & (F.col("new_chrom").eqNullSafe(F.col("own_chrom")) if check_chrom else F.lit(True))
    tells = F.coalesce(left, F.lit(True))
    bad = has(SECONDARY) | has(SUPPLEMENTARY) | (~single & ~(has(PAIRED) & has(PROPER)))
    tally = rows.groupBy(*by, "orig_name").agg(F.bool_or(bad).alias("poisoned"), F.count_if(right & tells).alias("n_right"), F.count_if(~right & tells).alias("n_wrong"), F.max("n_versions").alias("n_asked"), F.array_sort(F.collect_set("cigar")).alias("new_cigars"))
    verdict = (
        F.when(F.col("n_right").isNull(), "missing")
        .when(F.col("poisoned"), "poisoned")
        .when(F.col("n_wrong") > 0, "wrong_place")
        .when(F.col("n_right") != F.col("n_asked"), "incomplete")
        .when((F.size("new_cigars") > 2) | (F.col("cigars") != F.col("new_cigars")), "cigar_changed")
        .otherwise("keep")
    )
    judged = own.join(tally.withColumnRenamed("orig_name", "qname"), [*by, "qname"], "left").select(*by, "qname", verdict.alias("verdict"))
    return to_remap.join(judged, [*by, "qname"])


def kept(keep: DataFrame, judged: DataFrame) -> DataFrame:
    """Reads that needed no test and those that passed it."""
    return keep.unionByName(judged.where("verdict = 'keep'").select(*keep.columns))


def hash_order(*parts: Column | str, seed: int = 0) -> Column:
    """An order that depends on the values and a seed alone."""
    return F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts), F.lit(str(seed))))


def dedup_single(reads: DataFrame, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """One read, chosen by hash, of those at a position on a strand; only plain mapped reads stay.

    by: columns whose values are deduplicated apart, as individuals are.
    """
    w = Window.partitionBy(*by, "chrom", "pos", "flag").orderBy(hash_order("qname", seed=seed), "qname")
    return reads.where(is_plain_single()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup_pairs(reads: DataFrame, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Both reads of one pair, chosen by hash, of those with the same two positions; strand does not matter.

    by: columns whose values are deduplicated apart, as individuals are.
    """
    usable = reads.withColumn("_d", duplicate_disposition(F.col("mate_chrom") == F.col("chrom"))).where("_d = 'paired'").drop("_d")
    left, right = F.least("pos", "mate_pos"), F.greatest("pos", "mate_pos")
    names = usable.groupBy(*by, "chrom", "qname", left.alias("left"), right.alias("right")).agg(F.count("*").alias("n")).where("n = 2")
    w = Window.partitionBy(*by, "chrom", "left", "right").orderBy(hash_order(F.col("qname").cast("string"), seed=seed), "qname")
    chosen = names.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*by, "chrom", "qname")
    return usable.join(chosen, [*by, "chrom", "qname"], "left_semi")
