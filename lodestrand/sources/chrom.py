"""Chromosome tables, their classes and order, and regions of chromosomes on a command line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ("is_hap", "is_rand", "is_mito", "is_x", "is_y", "is_sex", "is_auto")


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, "^chr", "")


def classified(chroms: DataFrame) -> DataFrame:
    """chroms (chrom, length) with a flag for each class: haplotype contigs, random ones, mitochondrial, sex, autosomes."""
    bare = _bare(F.col("chrom"))
    hap, rand = F.col("chrom").rlike("_hap|_alt"), F.col("chrom").rlike("random|^chrUn|_un")
    mito = bare.rlike("^(M|MT)$")
    x, y = bare.rlike("^X$"), bare.rlike("^Y$")
    flags = {"is_hap": hap, "is_rand": rand & ~hap, "is_mito": mito, "is_x": x, "is_y": y, "is_sex": x | y | bare.rlike("^[WZ]$")}
    out = chroms.withColumns(flags)
    return out.withColumn("is_auto", ~(F.col("is_hap") | F.col("is_rand") | F.col("is_mito") | F.col("is_sex")))


def sort_key() -> Column:
    """Order of chromosomes: autosomes by number, then sex, mitochondrial, random and haplotype ones."""
    bare = _bare(F.col("chrom"))
    padded = F.when(bare.rlike("^[0-9]+$"), F.lpad(bare, 5, "0")).otherwise(bare)
    return F.struct(F.col("is_hap"), F.col("is_rand"), F.col("is_mito"), F.col("is_sex"), padded.alias("name"))


def numbered(chroms: DataFrame) -> DataFrame:
    """Classified chromosomes with idnum: their place in order, from 1.  A chromosome table is small."""
    from pyspark.sql import Window

    return classified(chroms).withColumn("idnum", F.row_number().over(Window.orderBy(sort_key(), "chrom")).cast("int"))


def read_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, flags and idnum from a table of at least two columns; plain or gzip, lines of less are an error."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    parts = F.split(F.trim("value"), r"\s+")
    length = parts[1].try_cast("long") if hasattr(Column, "try_cast") else parts[1].cast("long")
    checked = F.when((F.size(parts) >= 2) & (length >= 1), length).otherwise(F.raise_error(F.concat(F.lit("not a chromosome and its length: "), F.col("value"))).cast("long"))
    return numbered(lines.select(parts[0].alias("chrom"), checked.alias("length")))


def choose(chroms: DataFrame, autosomes: bool = True, x: bool = True, y: bool = False, other_sex: bool = True, rand: bool = False, hap: bool = False, mito: bool = False) -> DataFrame:
    """The chromosomes of the classes asked for."""
    keep = F.lit(False)
    for wanted, flag in ((autosomes, F.col("is_auto")), (rand, F.col("is_rand")), (hap, F.col("is_hap")), (mito, F.col("is_mito")), (x, F.col("is_x")), (y, F.col("is_y")), (other_sex, F.col("is_sex") & ~F.col("is_x") & ~F.col("is_y"))):
        if wanted:
            keep = keep | flag
    return chroms.where(keep)


def parse_names(text: str) -> list[str]:
    """Names of chromosomes written as chr2, 3, 1-22 or a list of these."""
    out: list[str] = []
    for part in re.split(r"[,\s]+", text.strip()):
        if m := re.fullmatch(r"(?:chr)?(\d+)-(?:chr)?(\d+)", part):
            low, high = int(m[1]), int(m[2])
            if low > high:
                raise ValueError(f"{part}: the first number is the larger")
            out += [f"chr{i}" for i in range(low, high + 1)]
        elif part:
            out.append(part if part.startswith("chr") else f"chr{part}")
    if not out:
        raise ValueError("no chromosome is named")
    return list(dict.fromkeys(out))


def guessed(texts: DataFrame, chroms: DataFrame, text: str = "path") -> DataFrame:
    """texts with chrom: the longest chromosome name that the text holds, or null.  The names are few, so they go along as an array."""
    names = [r[0] for r in chroms.select("chrom").collect()]  # a chromosome table is small
    held = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.col(text), n))
    longest = F.aggregate(held, F.lit(None).cast("string"), lambda best, n: F.when(best.isNull() | (F.length(n) > F.length(best)), n).otherwise(best))
    return texts.withColumn("chrom", longest)
