"""CIGAR expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which operations take up read bases, and which reference bases.
ON_READ, ON_REFERENCE = "MIS=X", "MDN=X"
#: Operations that align bases one to one, for allele work and for counting.
ALIGNED = {"alleles": "M=X", "counts": "M"}


def operations(cigar: Column) -> Column:
    """The CIGAR as an array of (n, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.left(x, F.length(x) - 1).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))


def _total(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0).cast("long"), lambda s, o: s + F.when(F.instr(F.lit(kinds), o["op"]) > 0, o["n"]).otherwise(0))


def read_length(cigar: Column) -> Column:
    """Read bases that the operations take up."""
    return _total(operations(cigar), ON_READ)


def reference_length(cigar: Column) -> Column:
    """Reference bases that the operations span."""
    return _total(operations(cigar), ON_REFERENCE)


def aligned_length(cigar: Column) -> Column:
    """Read bases that are neither clipped nor inserted."""
    return _total(operations(cigar), "M=X")


def blocks(pos: Column, cigar: Column, deleted: bool = False) -> Column:
    """Array of (start, stop, read_start, op): reference stretches from pos on, and where each begins in the read (from 1).

    Aligned operations give a block each; deleted adds those of D, which have
    no read bases.  N, S, H, I and P give none.
    """
    start = F.struct(pos.cast("long").alias("g"), F.lit(1).cast("long").alias("r"), F.array().cast("array<struct<start:bigint,stop:bigint,read_start:bigint,op:string>>").alias("out"))

    def step(s: Column, o: Column) -> Column:
        shown = F.instr(F.lit(ON_READ), o["op"]) > 0
        on_read = F.when(shown, o["n"]).otherwise(0)
        on_reference = F.when(F.instr(F.lit(ON_REFERENCE), o["op"]) > 0, o["n"]).otherwise(0)
        kinds = ALIGNED["alleles"] + ("D" if deleted else "")
        block = F.array(F.struct(s["g"].alias("start"), (s["g"] + o["n"] - 1).alias("stop"), s["r"].alias("read_start"), o["op"].alias("op")))
        return F.struct((s["g"] + on_reference).alias("g"), (s["r"] + on_read).alias("r"), F.when(F.instr(F.lit(kinds), o["op"]) > 0, F.concat(s["out"], block)).otherwise(s["out"]).alias("out"))

    return F.aggregate(operations(cigar), start, step, lambda s: s["out"])


def is_countable(cigar: Column) -> Column:
    """Whether counting knows every operation (=, X and P are not known to it)."""
    return ~cigar.rlike("[=XP]")


def is_whole(cigar: Column) -> Column:
    """Whether no base of the read is clipped but still there."""
    return ~cigar.contains("S")
