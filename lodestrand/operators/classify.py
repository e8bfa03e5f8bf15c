"""What becomes of a read by its flag: one CASE per tool, in that tool's order of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: SAM flag bits (fixed values).
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECONDARY, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x8, 0x10, 0x40, 0x100, 0x800


def has(bit: int, flag: Column | None = None) -> Column:
    return (F.col("flag") if flag is None else flag).bitwiseAND(bit) != 0


def mapping_disposition(same_chrom: Column | None = None) -> Column:
    """Of a read on its way to the variant join: why it is left out, or `single` or `paired`."""
    far = ~same_chrom if same_chrom is not None else F.lit(False)
    return (
        F.when(has(UNMAPPED), "unmapped")
        .when(has(SECONDARY), "secondary")
        .when(has(SUPPLEMENTARY), "supplementary")
        .when(~has(PAIRED), "single")
        .when(has(MATE_UNMAPPED), "mate_unmapped")
        .when(far, "different_chromosome")
        .when(~has(PROPER), "improper_pair")
        .otherwise("paired")
    )


def duplicate_disposition(same_chrom: Column) -> Column:
    """Of a read on its way to the removal of duplicate pairs; supplementary reads stay."""
    return (
        F.when(has(UNMAPPED), "unmapped")
        .when(has(MATE_UNMAPPED), "mate_unmapped")
        .when(has(SECONDARY), "secondary")
        .when(~has(PAIRED), "not_paired")
        .when(~same_chrom, "different_chromosome")
        .when(~has(PROPER), "improper_pair")
        .otherwise("paired")
    )


def is_plain_single() -> Column:
    """Whether a single read is primary and mapped, on either strand, and nothing else."""
    return F.col("flag").isin(0, REVERSE)


def report(reads: DataFrame) -> DataFrame:
    """How many reads have each disposition, and their share of all."""
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return reads.groupBy("disposition").agg(F.count("*").alias("n"), (F.count("*") / total).alias("share"))
