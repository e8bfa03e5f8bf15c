"""Reads that cover variants, and the versions of them that are aligned again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles, cigar, seq
from .classify import mapping_disposition
from .counts import subset_samples
from .overlap import count_within, in_bins, members_within, site_counts, variant_bins

MAX_SNPS, MAX_SEQS = 6, 64


def sites_of(reads: DataFrame, snps: DataFrame, key: str = "qname", most: int | None = None) -> DataFrame:
    """key, chrom, seq, n_snps, n_indels and sites (read_pos, ref, alt, site; by position) of each read that covers a variant.

    With most, a bin's sites are not listed where a read covers more SNPs than that in it, or an indel:
    the lists of reads with more, or with an indel, are not whole, those of all others are.
    """
    blocks = reads.select(key, "chrom", "seq", F.inline(cigar.blocks(F.col("pos"), F.col("cigar"), deleted=True)))
    here = site_counts(blocks, variant_bins(snps), most).where("n_snps + n_indels > 0")
    return here.groupBy(key).agg(F.first("chrom").alias("chrom"), F.first("seq").alias("seq"), F.sum("n_snps").alias("n_snps"), F.sum("n_indels").alias("n_indels"), _listed(F.col("sites")).alias("sites"))


def _listed(sites: Column) -> Column:
    """The lists of a group as one, by position in the read; nulls are none."""
    return F.sort_array(F.flatten(F.collect_list(sites)))


def _fit_to_expand(max_snps: int) -> Column:
    return (F.col("n_indels") == 0) & F.col("n_snps").between(1, max_snps)


def expanded(sites: DataFrame, genotypes: DataFrame | None = None, key: str = "qname", max_snps: int = MAX_SNPS) -> DataFrame:
    """key, seq and seqs: all versions of reads (what sites_of() gives) with 1 to max_snps SNPs and no indel, the read's own sequence among them or not.

    Without genotypes every base a site may have is tried; with them the
    haplotypes of the samples, and what unphased sites allow.  The bound on
    SNPs holds before anything is made, so a read's versions are few.
    """
    own = sites.where(_fit_to_expand(max_snps))
    if genotypes is None:
        return own.select(key, "seq", alleles.all_versions(F.col("seq"), F.col("sites")).alias("seqs"))
    each = own.select(key, "seq", "chrom", F.explode("sites").alias("s")).select(key, "seq", "chrom", "s.*")
    haps = genotypes.select("chrom", F.col("pos").alias("site"), "sample", "hap1", "hap2", F.coalesce("phased", F.lit(False)).alias("phased"))
    at = each.join(haps, ["chrom", "site"])
    by_sample = at.groupBy(key, "sample").agg(F.first("seq").alias("seq"), F.sort_array(F.collect_list(F.struct("read_pos", "ref", "alt", "hap1", "hap2", "phased"))).alias("sites"))
    seen = by_sample.select(key, "seq", "sites").distinct()  # samples with the same haplotypes make the same versions
    made = seen.select(key, "seq", F.explode_outer(alleles.haplotype_versions(F.col("seq"), F.col("sites"))).alias("v"))
    return made.groupBy(key).agg(F.first("seq").alias("seq"), F.collect_set("v").alias("seqs"))


def split_single(reads: DataFrame, snps: DataFrame, genotypes: DataFrame | None = None, samples: list[str] | None = None, max_snps: int = MAX_SNPS, max_seqs: int = MAX_SEQS) -> tuple[DataFrame, DataFrame]:
    """Reads with a disposition, and the versions of those to be aligned again.

    Dispositions: the flag's, or keep (nothing to test), remap, indel,
    excess_snps, excess_versions.  Versions: qname, pos, version_no, n_versions,
    name and seq, numbered by sequence.  A read's name is its key; where several
    individuals share names, put the individual into them.
    """
    if max_snps < 1 or max_seqs < 1:
        raise ValueError("max_snps and max_seqs must be 1 or more")
    if genotypes is not None and samples:
        genotypes = subset_samples(genotypes, samples)
    rows = reads.withColumn("disposition", mapping_disposition())
    sites = sites_of(rows.where("disposition = 'single'"), snps, most=max_snps)
    fresh = lambda seqs: F.array_sort(F.array_except(seqs, F.array("seq")))
    if genotypes is None:  # versions are made where the sites are, so that reads are joined once
        found = sites.withColumn("others", F.when(_fit_to_expand(max_snps), fresh(alleles.all_versions(F.col("seq"), F.col("sites")))))
    else:
        made = expanded(sites, genotypes, max_snps=max_snps).select("qname", fresh("seqs").alias("others"))
        found = sites.join(made, "qname", "left")
    n = F.coalesce(F.size("others"), F.lit(0))
    judged = (
        F.when(F.col("disposition") != "single", F.col("disposition"))
        .when(F.coalesce("n_indels", F.lit(0)) > 0, "indel")
        .when(F.coalesce("n_snps", F.lit(0)) > max_snps, "excess_snps")
        .when(n == 0, "keep")
        .when(n < max_seqs, "remap")
        .otherwise("excess_versions")
    )
    joined = rows.join(found.select("qname", "n_snps", "n_indels", "others"), "qname", "left").withColumn("disposition", judged)
    versions = joined.where("disposition = 'remap'").select("qname", "pos", F.size("others").alias("n_versions"), F.posexplode("others").alias("i", "seq"))
    versions = versions.select("qname", "pos", (F.col("i") + 1).alias("version_no"), "n_versions", alleles.encode_name(F.col("qname"), [F.col("pos")], F.col("i") + 1, F.col("n_versions")).alias("name"), "seq")
    return joined.select(*reads.columns, "disposition"), versions


def mates(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (qname, chrom, a, b: structs of the first and second read by position, and ok), and reads whose mate is missing.

    Reads take part that the flag calls paired; a pair is ok if the second
    read's mate position is the first one's.
    """
    near = F.col("mate_chrom") == F.col("chrom")
    usable = reads.withColumn("disposition", mapping_disposition(near)).where("disposition = 'paired'")
    row = F.struct("pos", "mate", *(c for c in reads.columns if c not in ("qname", "chrom", "pos", "mate")))
    both = usable.groupBy("chrom", "qname").agg(F.sort_array(F.collect_list(row)).alias("r"))
    pairs = both.where(F.size("r") == 2).select("qname", "chrom", F.col("r")[0].alias("a"), F.col("r")[1].alias("b"), (F.col("r")[1]["mate_pos"] == F.col("r")[0]["pos"]).alias("ok"))
    return pairs, both.where(F.size("r") != 2).select("qname", "chrom", F.size("r").alias("n"))


def pair_versions(own_a: Column, own_b: Column, sites_a: Column, sites_b: Column, at_a: Column, at_b: Column, max_seqs: int = MAX_SEQS) -> Column:
    """Versions of a pair (seq_a, seq_b; sorted) whose mates agree at the SNPs that both cover; null if there are too many.

    at_a, at_b: positions in either read of shared SNPs.  Before pairs of
    versions are made it is known that both mates' versions are max_seqs
    together at most; the result may be as many, besides the original.
    """
    a, b = alleles.all_versions(own_a, sites_a), alleles.all_versions(own_b, sites_b)
    keyed = lambda v, at: F.transform(v, lambda x: F.struct(seq.bases_at(x, at).alias("key"), x.alias("seq")))
    made = F.flatten(F.transform(keyed(a, at_a), lambda x: F.transform(F.filter(keyed(b, at_b), lambda y: y["key"] == x["key"]), lambda y: F.struct(x["seq"].alias("seq_a"), y["seq"].alias("seq_b")))))
    return F.when(F.size(a) + F.size(b) <= max_seqs, F.sort_array(made))


def shared_sites(pairs: DataFrame, snps: DataFrame) -> DataFrame:
    """qname, n_shared and discordant of pairs (what mates() gives) whose mates cover the same SNPs: how many, and whether they show different bases there."""
    blocks = lambda x: cigar.blocks(F.col(f"{x}.pos"), F.col(f"{x}.cigar"))
    both = lambda x, y: F.struct(F.greatest(x["start"], y["start"]).alias("start"), F.least(x["stop"], y["stop"]).alias("stop"), (x["read_start"] - x["start"]).alias("to_a"), (y["read_start"] - y["start"]).alias("to_b"))
    common = F.flatten(F.transform(blocks("a"), lambda x: F.transform(F.filter(blocks("b"), lambda y: (y["start"] <= x["stop"]) & (x["start"] <= y["stop"])), lambda y: both(x, y))))
    stretches = pairs.select("qname", "chrom", F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), F.inline(common))
    n = count_within("_snps_upto")
    base = lambda s, to, v: F.substr(F.col(s), (F.col(to) + v["site"]).cast("int"), F.lit(1))
    differ = F.exists(members_within("_snps", "_snps_upto"), lambda v: base("seq_a", "to_a", v) != base("seq_b", "to_b", v))
    here = in_bins(stretches, variant_bins(snps)).where(n > 0).select("qname", n.cast("long").alias("n"), differ.alias("differ"))
    return here.groupBy("qname").agg(F.sum("n").alias("n_shared"), F.bool_or("differ").alias("discordant"))


def split_pairs(reads: DataFrame, snps: DataFrame, max_snps: int = MAX_SNPS, max_seqs: int = MAX_SEQS) -> tuple[DataFrame, DataFrame]:
    """Pairs with a disposition (keep, remap, indel, excess_snps, excess_versions, discordant, mate_pos_mismatch),
    and the versions of those to be aligned again (qname, pos_a, pos_b, version_no, n_versions, name, seq_a, seq_b).

    A pair whose mates show different bases at a shared SNP is discordant.
    Mates are brought together, meet the variants of their bins and come
    together again; versions are made within the pair's row.
    """
    pairs, _ = mates(reads)
    side = lambda x: F.struct(F.lit(x).alias("side"), F.col(f"{x}.pos").cast("long").alias("pos"), F.col(f"{x}.seq").alias("seq"), F.when(F.col("ok"), cigar.blocks(F.col(f"{x}.pos"), F.col(f"{x}.cigar"), deleted=True)).alias("blocks"))
    each = pairs.select("qname", "chrom", "ok", F.inline(F.array(side("a"), side("b"))))
    blocks = each.select("qname", "chrom", "ok", "side", "pos", "seq", F.explode_outer("blocks").alias("_b")).select("qname", "chrom", "ok", "side", "pos", "seq", "_b.*")
    own = site_counts(blocks, variant_bins(snps), max_snps, "left")
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    total = lambda s: F.coalesce(F.sum(of(s, "n_snps")), F.lit(0))
    state = own.groupBy("chrom", "qname").agg(F.first("ok").alias("ok"), F.sum("n_indels").alias("indels"), F.greatest(total("a"), total("b")).alias("snps"), *(F.max(of(s, c)).alias(f"{name}_{s}") for s in "ab" for c, name in (("pos", "pos"), ("seq", "own"))), *(_listed(of(s, "sites")).alias(f"s_{s}") for s in "ab"))
    common = F.array_intersect(F.transform("s_a", lambda s: s["site"]), F.transform("s_b", lambda s: s["site"]))
    state = state.withColumn("fair", F.col("ok") & (F.col("indels") == 0) & (F.col("snps") <= max_snps)).withColumn("common", common)
    at = lambda s: F.transform(F.filter(s, lambda x: F.array_contains("common", x["site"])), lambda x: x["read_pos"].cast("int"))
    state = state.withColumns({"at_a": at("s_a"), "at_b": at("s_b")})
    state = state.withColumn("agree", seq.bases_at(F.col("own_a"), F.col("at_a")) == seq.bases_at(F.col("own_b"), F.col("at_b")))
    made = pair_versions(*(F.col(c) for c in ("own_a", "own_b", "s_a", "s_b", "at_a", "at_b")), max_seqs)
    state = state.withColumn("made", F.when(F.col("fair") & F.col("agree"), made))
    n = F.when(F.size("made") <= max_seqs + 1, F.size("made") - 1).cast("long")
    state = state.select("qname", "chrom", "pos_a", "pos_b", "ok", "indels", "snps", "agree", "own_a", "own_b", "made", n.alias("n"))
    judged = (
        F.when(~F.col("ok"), "mate_pos_mismatch")
        .when(F.col("indels") > 0, "indel")
        .when(F.col("snps") > max_snps, "excess_snps")
        .when(~F.col("agree"), "discordant")
        .when(F.col("n").isNull(), "excess_versions")
        .when(F.col("snps") == 0, "keep")
        .otherwise("remap")
    )
    classified = state.withColumn("disposition", judged).withColumn("n_versions", F.coalesce("n", F.lit(0)))
    fresh = F.filter("made", lambda v: (v["seq_a"] != F.col("own_a")) | (v["seq_b"] != F.col("own_b")))
    versions = classified.where("disposition = 'remap'").select("qname", "pos_a", "pos_b", "n_versions", F.posexplode(fresh).alias("i", "v")).select("qname", "pos_a", "pos_b", (F.col("i") + 1).alias("version_no"), "n_versions", "v.*")
    name = alleles.encode_name(F.col("qname").cast("string"), [F.col("pos_a"), F.col("pos_b")], F.col("version_no"), F.col("n_versions"))
    return classified.select("qname", "chrom", "pos_a", "pos_b", "disposition", "n_versions"), versions.select("qname", "pos_a", "pos_b", "version_no", "n_versions", name.alias("name"), "seq_a", "seq_b")
