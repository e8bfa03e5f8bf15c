"""Coordinates: closed intervals from 1, with an optional strand of -1, 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(start: Column, stop: Column, strand: Column | None = None) -> Column:
    """Whether it is an interval at all."""
    ok = (start >= 1) & (stop >= start)
    return ok & strand.isin(-1, 0, 1) if strand is not None else ok


def length(start: Column, stop: Column) -> Column:
    return stop - start + 1


def expanded(start: Column, stop: Column, by: int, chrom_length: Column) -> Column:
    """The interval wider by so much on either side, kept inside the chromosome."""
    return F.struct(F.greatest(start - by, F.lit(1)).alias("start"), F.least(stop + by, chrom_length).alias("stop"))


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column], strands: tuple[Column, Column] | None = None) -> Column:
    """Whether two intervals of a chromosome share a base (and a strand, where given and known)."""
    hit = (a[0] <= b[1]) & (b[0] <= a[1])
    return hit & ((strands[0] == 0) | (strands[1] == 0) | (strands[0] == strands[1])) if strands else hit


def within(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether a lies inside b."""
    return (a[0] >= b[0]) & (a[1] <= b[1])


def resized(starts: Column, stops: Column, size: int, chrom_length: Column) -> tuple[Column, Column]:
    """One interval of a fixed size about the middle of a region's first start and last stop, kept inside the chromosome."""
    middle = F.floor((F.array_min(starts) + F.array_max(stops)) / 2)
    start = F.greatest(middle - size // 2, F.lit(1))
    return start.cast("long"), F.least(start + size - 1, chrom_length).cast("long")


def text(chrom: Column, start: Column, stop: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string"))


def bare_name(chrom: Column) -> Column:
    """A chromosome's name without chr, for joins that take either form."""
    return F.regexp_replace(chrom, "^chr", "")


def key(idnum: Column, start: Column, strand: Column | None = None) -> Column:
    """What coordinates are sorted by: the chromosome's number, the strand if asked for, and the start."""
    return F.struct(idnum.alias("idnum"), *([strand.alias("strand")] if strand is not None else []), start.alias("start"))
