"""Proof that files are sorted by chromosome and position, split by split.

Each split tells, of each chromosome it holds, the first and last position, how
many rows there are and where the order breaks; the splits of a file are then
put after each other.  A break is a position before the one ahead of it, or a
row of a chromosome that another one has already followed.  What a task gives
is a row for each chromosome of a split, however disordered the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PARTS = "file string, start long, turn int, chrom string, first_pos long, last_pos long, n long, breaks long, broken_at long, ends boolean, repeats long"


class _Split:
    """What was seen of one split so far."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.now = file, start, None
        self.seen: dict[str, list] = {}

    def add(self, chrom: str, pos: np.ndarray) -> None:
        """Successive rows of a chromosome."""
        own = self.seen.get(chrom)
        down = np.flatnonzero(pos[1:] < pos[:-1]) + 1
        same = int((pos[1:] == pos[:-1]).sum())
        first = None if not len(down) else int(pos[down[0]])
        if own is None:
            self.seen[chrom] = [int(pos[0]), int(pos[-1]), len(pos), len(down), first, same]
        else:
            back = self.now != chrom or int(pos[0]) < own[1]
            own[5] += same + (self.now == chrom and int(pos[0]) == own[1])
            own[4] = own[4] if own[4] is not None else int(pos[0]) if back else first
            own[1], own[2], own[3] = int(pos[-1]), own[2] + len(pos), own[3] + len(down) + back
        self.now = chrom

    def rows(self) -> list[tuple]:
        return [(self.file, self.start, i, c, *v[:5], c == self.now, v[5]) for i, (c, v) in enumerate(self.seen.items())]


def _parts(rows: DataFrame) -> DataFrame:
    """A row for each chromosome of each split; rows: file, start, chrom, pos, those of a split one after another."""
    names, kinds = zip(*((n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _PARTS.split(", "))), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        out: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            # rows are cut wherever split or chromosome changes
            coded = [b.column(c).dictionary_encode() for c in ("file", "start", "chrom")]
            codes = np.stack([c.indices.to_numpy() for c in coded])
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            pos = b.column("pos").to_numpy()
            values = [c.dictionary.to_pylist() for c in coded]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                file, start, chrom = (v[k] for v, k in zip(values, codes[:, low].tolist(), strict=True))
                if split is None or (split.file, split.start) != (file, start):
                    out += split.rows() if split else []
                    split = _Split(file, start)
                split.add(chrom, pos[low:high])
        out += split.rows() if split else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=list(names))

    return rows.mapInArrow(run, _PARTS)


def report(rows: DataFrame, file: Column | None = None, start: Column | None = None, strict: bool = False) -> DataFrame:
    """file, chrom, n, first_pos, last_pos, breaks and broken_at (the position of a first break, or null).

    file and start tell the splits and their order: _metadata.file_path and
    _metadata.file_block_start of text; by default the partitions, in their
    order, are the splits of one file, as those of a BAM file are.  strict:
    equal positions in a row are breaks too.
    """
    parts = _parts(rows.select((file if file is not None else F.lit("")).alias("file"), (start if start is not None else F.spark_partition_id()).cast("long").alias("start"), F.coalesce("chrom", F.lit("*")).alias("chrom"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos")))
    # of a file, a row for each split and chromosome: what ended the split before, and whether the chromosome was there before
    # (windows alone, so that the rows are read once)
    ahead = Window.partitionBy("file").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file", "chrom").orderBy("start")
    joined = parts.withColumn("_ended", F.last(F.when(F.col("ends"), F.col("chrom")), ignorenulls=True).over(ahead)).withColumn("_before", F.lag("last_pos").over(own))
    goes_on = (F.col("turn") == 0) & F.col("_ended").eqNullSafe(F.col("chrom"))
    back = F.col("_before").isNotNull() & (~goes_on | (F.col("first_pos") < F.col("_before")))
    same = F.col("repeats") + F.when(F.col("_before").isNotNull() & goes_on & (F.col("first_pos") == F.col("_before")), 1).otherwise(0)
    breaks = F.col("breaks") + back.cast("long") + (same if strict else F.lit(0))
    found = joined.withColumns({"_all": breaks, "_at": F.when(back, F.col("first_pos")).otherwise(F.col("broken_at"))})
    return found.groupBy("file", "chrom").agg(F.sum("n").alias("n"), F.min_by("first_pos", "start").alias("first_pos"), F.max_by("last_pos", "start").alias("last_pos"), F.sum("_all").alias("breaks"), F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col("start"))).alias("broken_at"))


def checked(rows: DataFrame, file: Column | None = None, start: Column | None = None, strict: bool = False) -> DataFrame:
    """The report; a file that is not sorted is an error that names chromosome and position."""
    told = F.concat_ws(" ", F.lit("not sorted:"), "file", "chrom", F.lit("at"), F.coalesce(F.col("broken_at").cast("string"), F.lit("a repeated position")))
    return report(rows, file, start, strict).withColumn("breaks", F.when(F.col("breaks") == 0, F.col("breaks")).otherwise(F.raise_error(told).cast("long")))
