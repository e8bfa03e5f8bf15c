"""Nucleotide expressions: every one is a Column, evaluated by the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC letters, case kept (fixed values).
BASES, COMPLEMENTS = "ATCGMRWSYKNatcgmrwsykn", "TAGCKYWSRMNtagckywsrmn"
#: Numbers of nucleotides (fixed values): A, C, G, T, gap, and what is ambiguous.
NUCLEOTIDES = ("A", "C", "G", "T", "-", "N")


def complement(seq: Column) -> Column:
    """Each letter's complement; unknown letters stay."""
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def nucleotide_id(base: Column) -> Column:
    """0 to 3 for A, C, G, T, 4 for a gap, 5 for anything else."""
    at = F.instr(F.lit("".join(NUCLEOTIDES[:5])), F.upper(base)) - 1
    return F.when((F.length(base) == 1) & (at >= 0), at).otherwise(5)


def nucleotide_char(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, NUCLEOTIDES)), number), F.lit("N"))


def is_real_base(base: Column) -> Column:
    """Whether it is one of A, C, G, T in either case."""
    return F.coalesce(base.rlike("^[ACGTacgt]$"), F.lit(False))


def is_ambiguous(base: Column) -> Column:
    """Whether it is a letter for several nucleotides."""
    return F.coalesce(base.rlike("^[MRWSYKNmrwsykn]$"), F.lit(False))


def has_unknown(seq: Column) -> Column:
    """Whether an N is in the sequence."""
    return F.upper(seq).contains("N")


def bases_at(seq: Column, positions: Column) -> Column:
    """The bases at an array of positions (from 1), joined."""
    return F.array_join(F.transform(positions, lambda p: F.substr(seq, p, F.lit(1))), "")


def substitute(seq: Column, position: Column, allele: Column) -> Column:
    """seq with one base, at position (from 1), replaced by an allele."""
    return F.concat(F.substr(seq, F.lit(1), position - 1), allele, F.substr(seq, position + 1))


def count_bases(seq: Column, bases: str) -> Column:
    """How many letters of seq are among bases, case as given."""
    return F.length(seq) - F.length(F.translate(seq, bases, ""))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C among A, C, G, T; upper case counts alone; null without any."""
    gc, at = count_bases(seq, "GC"), count_bases(seq, "AT")
    return F.when(gc + at > 0, gc / (gc + at))


def wrap(seq: Column, width: int = 70) -> Column:
    """seq in lines of width letters."""
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"))
