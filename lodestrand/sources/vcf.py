"""VCF files as typed tables; text is split by the JVM and nothing is read twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines as line_source

#: log10 likelihood of what is missing (a third of one), as an array of three (fixed value).
MISSING_GL = -0.477


def format_index(fmt: Column, label: str) -> Column:
    """Place of a label in a FORMAT column, from 0; null if it is not there."""
    at = F.array_position(F.split(fmt, ":"), label)
    return F.when(at > 0, (at - 1).cast("int"))


def field(fmt: Column, sample: Column, label: str) -> Column:
    """The part of a sample column that a label names, or null."""
    return F.get(F.split(sample, ":"), format_index(fmt, label))


def parse_genotype(gt: Column) -> tuple[Column, Column, Column]:
    """hap1, hap2 and phased of a genotype; alleles that are not 0 or 1 on either haplotype make both null.

    What is not two alleles with a bar or slash is missing and counts as phased.
    """
    shape = r"^(\d+)([|/])(\d+)$"
    a, sep, b = (F.regexp_extract(gt, shape, i) for i in (1, 2, 3))
    ok = a.isin("0", "1") & b.isin("0", "1")
    return F.when(ok, a.cast("byte")), F.when(ok, b.cast("byte")), F.coalesce(sep != "/", F.lit(True))


def normalised(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.transform(values, lambda x: x / total)


def parse_likelihoods(gl: Column, phred: bool = False) -> Column:
    """Three probabilities from log10 likelihoods (or from phred-scaled ones), or equal ones where they are missing; null without the field."""
    parts = F.transform(F.split(gl, ","), lambda x: F.pow(F.lit(10.0), -x.cast("double") / 10 if phred else x.cast("double")))
    none = F.array(*[F.lit(10.0**MISSING_GL)] * 3)
    return F.when(gl.isNull(), None).otherwise(normalised(F.when(gl.contains("."), F.when(gl.rlike(r"^\.(,\.)*$"), none).otherwise(parts)).otherwise(parts)))


def parse_probabilities(gp: Column) -> Column:
    """Three probabilities from GP, scaled to add up to 1 if they miss it by more than 0.001; .333 each where missing; null without the field."""
    parts = F.transform(F.split(gp, ","), lambda x: x.cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    fine = F.when(total.between(0.999, 1.001), parts).otherwise(normalised(parts))
    return F.when(gp.isNull(), None).when(gp.rlike(r"^\.(,\.)*$"), F.array(*[F.lit(0.333)] * 3)).otherwise(fine)


def genotype_probabilities(fmt: Column, sample: Column, pl_as_gl: bool = False) -> Column:
    """From GP, else GL, else PL, else null.  pl_as_gl reads phred-scaled values as if they were log10 ones."""
    return F.coalesce(parse_probabilities(field(fmt, sample, "GP")), parse_likelihoods(field(fmt, sample, "GL")), parse_likelihoods(field(fmt, sample, "PL"), phred=not pl_as_gl))


def read_samples(spark: SparkSession, paths: str | list[str], in_blocks: bool = False) -> list[str]:
    """Sample names of the header line, which all files must share."""
    lines = line_source.block_lines(spark, paths) if in_blocks else spark.read.text(paths)
    heads = lines.select("value").where(F.col("value").startswith("#CHROM")).distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError("no #CHROM line" if not heads else "the files have different samples")
    return heads[0][0].split("\t")[9:]


def read_lines(spark: SparkSession, paths: str | list[str], max_lines: int | None = None, in_blocks: bool = False) -> DataFrame:
    """chrom, pos, name, allele1, allele2, format and fields (an array) of each record; max_lines is of each file.

    in_blocks: files of block gzip are read in splits (pyarrow must know their folder), others as ever.
    """
    if in_blocks:
        lines = line_source.block_lines(spark, paths)
    else:
        lines = spark.read.text(paths) if max_lines is None else line_source.text_lines(spark, paths)
    lines = lines.where("value <> '' AND NOT startswith(value, '#')")
    if max_lines is not None:
        lines = line_source.first_lines(lines, max_lines)
    p = F.split("value", "\t")
    return lines.select(p[0].alias("chrom"), p[1].cast("long").alias("pos"), p[2].alias("name"), p[3].alias("allele1"), p[4].alias("allele2"), F.get(p, F.lit(8)).alias("format"), F.slice(p, F.lit(10), F.greatest(F.size(p) - 9, F.lit(0))).alias("fields"))


def read_variants(spark: SparkSession, paths: str | list[str], chroms: DataFrame | None = None, max_lines: int | None = None, in_blocks: bool = False, strict: bool = False) -> DataFrame:
    """chrom, pos, name, allele1, allele2; with chroms (chrom, length), names are matched with or without chr and positions checked."""
    rows = read_lines(spark, paths, max_lines, in_blocks).drop("format", "fields")
    return placed(rows, chroms, strict) if chroms is not None else rows


def placed(rows: DataFrame, chroms: DataFrame, strict: bool = False) -> DataFrame:
    """rows with chromosome names as chroms has them; a position outside is an error, an unknown chromosome goes, or is an error if strict."""
    known = F.broadcast(chroms.select(F.col("chrom").alias("_own"), "length", F.regexp_replace("chrom", "^chr", "").alias("_bare")))  # a row per chromosome
    at = rows.join(known, F.regexp_replace("chrom", "^chr", "") == F.col("_bare"), "left" if strict else "inner")
    if strict:
        at = at.withColumn("_own", F.when(F.col("_own").isNotNull(), F.col("_own")).otherwise(F.raise_error(F.concat(F.lit("unknown chromosome: "), F.col("chrom"))).cast("string")))
    pos = F.when(F.col("pos").between(1, F.col("length")), F.col("pos")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("position outside of"), F.col("_own"), F.col("pos").cast("string"))).cast("long"))
    return at.select(*(F.col("_own").alias("chrom") if c == "chrom" else pos.alias("pos") if c == "pos" else F.col(c) for c in rows.columns))


def read_genotypes(spark: SparkSession, paths: str | list[str], chroms: DataFrame | None = None, pl_as_gl: bool = False, max_lines: int | None = None, in_blocks: bool = False, strict: bool = False) -> DataFrame:
    """A row per variant and sample: chrom, pos, name, allele1, allele2, sample, hap1, hap2, phased, p_rr, p_ra, p_aa.

    strict: a chromosome that chroms does not have is an error, else its rows go.
    """
    names = read_samples(spark, paths, in_blocks)
    rows = read_lines(spark, paths, max_lines, in_blocks)
    rows = placed(rows, chroms, strict) if chroms is not None else rows
    each = rows.select("chrom", "pos", "name", "allele1", "allele2", "format", F.posexplode("fields").alias("_i", "_v"))
    hap1, hap2, phased = parse_genotype(field(F.col("format"), F.col("_v"), "GT"))
    p = genotype_probabilities(F.col("format"), F.col("_v"), pl_as_gl)
    each = each.withColumns({"sample": F.get(F.array(*map(F.lit, names)), F.col("_i")), "hap1": hap1, "hap2": hap2, "phased": phased, "_p": p})
    return each.select("chrom", "pos", "name", "allele1", "allele2", "sample", "hap1", "hap2", "phased", *(F.get("_p", F.lit(i)).cast("float").alias(c) for i, c in enumerate(("p_rr", "p_ra", "p_aa"))))
