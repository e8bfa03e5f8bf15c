"""Genotype probabilities and haplotypes in the two-file format of imputation programs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, paths: str | list[str], chrom: str | None) -> DataFrame:
    p = F.split(F.trim("value"), "[ \t]+")
    named = F.lit(chrom) if chrom else F.regexp_extract(F.input_file_name(), r"(chr[0-9A-Za-z]+)", 1)
    return spark.read.text(paths).where("trim(value) <> ''").select(named.alias("chrom"), p[1].alias("name"), p[2].cast("long").alias("pos"), p[3].alias("allele1"), p[4].alias("allele2"), F.slice(p, F.lit(6), F.greatest(F.size(p) - 5, F.lit(0))).alias("values"))


def _checked(rows: DataFrame, fine: Column, message: str) -> DataFrame:
    """rows, of which one that is not fine is an error; each is looked at once."""
    return rows.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit(message), F.col("pos").cast("string"))).cast("boolean")))


def paired_files(probabilities: list[str], haplotypes: list[str], chroms: list[str]) -> list[tuple[str, str, str]]:
    """(chromosome, file of probabilities, file of haplotypes): files of one chromosome by their names, the longest that each holds.

    A file without a partner, or two of a chromosome, is an error.
    """

    def by_chrom(paths: list[str]) -> dict[str, str]:
        out: dict[str, str] = {}
        for p in paths:
            held = [c for c in chroms if re.search(rf"(?<![0-9A-Za-z]){re.escape(c)}(?![0-9A-Za-z])", p.rsplit("/", 1)[-1])]
            if not held or (best := max(held, key=len)) in out:
                raise ValueError(f"{p}: {'a second file of its chromosome' if held else 'no chromosome is named'}")
            out[best] = p
        return out

    a, b = by_chrom(probabilities), by_chrom(haplotypes)
    if a.keys() != b.keys():
        raise ValueError(f"files without a partner: {', '.join(sorted(a.keys() ^ b.keys()))}")
    return [(c, a[c], b[c]) for c in chroms if c in a]


def read_probabilities(spark: SparkSession, paths: str | list[str], samples: list[str], chrom: str | None = None) -> DataFrame:
    """A row per variant and sample: chrom, name, pos, allele1, allele2, sample, p_rr, p_ra, p_aa.

    The chromosome is read off the file's name unless given; a line with another
    number of values than three a sample is an error.
    """
    n = len(samples)
    rows = _checked(_rows(spark, paths, chrom), F.size("values") == 3 * n, f"not {3 * n} probabilities at ")
    each = F.transform(F.array(*map(F.lit, samples)), lambda s, i: F.struct(s.alias("sample"), *(F.get("values", i * 3 + k).cast("float").alias(c) for k, c in enumerate(("p_rr", "p_ra", "p_aa")))))
    return rows.select("chrom", "name", "pos", "allele1", "allele2", F.inline(each))


def read_haplotypes(spark: SparkSession, paths: str | list[str], samples: list[str], chrom: str | None = None) -> DataFrame:
    """A row per variant and sample: chrom, name, pos, allele1, allele2, sample, hap1, hap2; values other than 0 and 1 are an error."""
    n = len(samples)
    fine = (F.size("values") == 2 * n) & F.forall("values", lambda v: v.isin("0", "1"))
    rows = _checked(_rows(spark, paths, chrom), fine, f"not {2 * n} alleles of 0 or 1 at ")
    each = F.transform(F.array(*map(F.lit, samples)), lambda s, i: F.struct(s.alias("sample"), F.get("values", i * 2).cast("byte").alias("hap1"), F.get("values", i * 2 + 1).cast("byte").alias("hap2")))
    return rows.select("chrom", "name", "pos", "allele1", "allele2", F.inline(each))


def with_haplotypes(probabilities: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """Probabilities with the haplotypes of the same position, null where there are none; haplotypes elsewhere go."""
    own = haplotypes.dropDuplicates(["chrom", "pos", "sample"]).select("chrom", "pos", "sample", "hap1", "hap2")
    return probabilities.join(own, ["chrom", "pos", "sample"], "left")
