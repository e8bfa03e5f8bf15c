"""Allele expressions: kinds of variants, classes of bases, versions of reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seq import substitute


def is_snp(ref: Column, alt: Column) -> Column:
    """Whether both alleles are one letter of A, C, G, T; anything else counts as an indel."""
    return F.coalesce(ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$"), F.lit(False))


def is_length_changing(ref: Column, alt: Column) -> Column:
    """Whether an allele is not of length one (what counting calls an indel)."""
    return (F.length(ref) != 1) | (F.length(alt) != 1)


def allele_class(base: Column, ref: Column, alt: Column) -> Column:
    """ref, alt or other."""
    return F.when(base == ref, "ref").when(base == alt, "alt").otherwise("other")


def all_versions(seq: Column, sites: Column) -> Column:
    """Every distinct version of seq: at each site (read_pos, ref, alt) the base it has, ref and alt.

    Up to three to the power of the sites; bound the sites first.
    """
    return F.aggregate(
        sites,
        F.array(seq),
        lambda acc, s: F.array_distinct(F.flatten(F.transform(acc, lambda x: F.array(x, substitute(x, s["read_pos"].cast("int"), s["ref"]), substitute(x, s["read_pos"].cast("int"), s["alt"]))))),
    )


def haplotype_versions(seq: Column, sites: Column) -> Column:
    """Distinct versions of seq for one sample's haplotypes at sites (read_pos, ref, alt, hap1, hap2, phased).

    The two haplotypes as they are and, where a heterozygous site is not
    phased, both alleles with all else.  A haplotype with a missing allele is
    left out, so a sample that misses one on both gives none.
    """

    def put(x: Column, s: Column, hap: Column) -> Column:
        return substitute(x, s["read_pos"].cast("int"), F.when(hap == 0, s["ref"]).otherwise(s["alt"]))

    def version(name: str, other: str) -> Column:
        made = F.aggregate(
            sites,
            F.array(seq),
            lambda acc, s: F.flatten(F.transform(acc, lambda x: F.when((s["hap1"] != s["hap2"]) & ~s["phased"], F.array(put(x, s, s[name]), put(x, s, s[other]))).otherwise(F.array(put(x, s, s[name]))))),
        )
        known = F.forall(sites, lambda s: s[name].isNotNull())
        return F.when(known, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(version("hap1", "hap2"), version("hap2", "hap1")))


def encode_name(qname: Column, positions: list[Column], number: Column, total: Column) -> Column:
    """Name of a version that is aligned again: original.pos[-pos2].number.total."""
    return F.concat_ws(".", qname, F.concat_ws("-", *(p.cast("string") for p in positions)), number.cast("string"), total.cast("string"))


def decode_name(name: Column) -> Column:
    """(orig_name, exp_pos1, exp_pos2, version_no, n_versions) of such a name, whose original may hold dots."""
    parts = F.split(name, r"\.")
    positions = F.split(F.element_at(parts, -3), "-")
    return F.struct(
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), ".").alias("orig_name"),
        positions[0].cast("long").alias("exp_pos1"),
        F.get(positions, F.lit(1)).cast("long").alias("exp_pos2"),
        F.element_at(parts, -2).cast("int").alias("version_no"),
        F.element_at(parts, -1).cast("int").alias("n_versions"),
    )
