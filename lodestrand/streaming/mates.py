"""Streams of reads: mates are matched as they come, and starts are counted, with bounded state.

In a file-by-file stream a read waits in the state of its (chromosome, name)
until its mate comes or a timeout tells that it will not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIR = "chrom string, qname string, pos_a long, pos_b long, state string"


def pair_stream(reads: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Pairs (state `paired`) of a stream of reads (chrom, qname, pos), and reads whose mate did not come in time (`missing`)."""

    def match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chrom, qname = key
        if state.hasTimedOut:
            (pos,) = state.get
            state.remove()
            yield pd.DataFrame([(chrom, qname, pos, None, "missing")], columns=["chrom", "qname", "pos_a", "pos_b", "state"])
            return
        waiting = state.get[0] if state.exists else None
        out = []
        for pos in sorted(int(p) for b in batches for p in b["pos"]):
            if waiting is None:
                waiting = pos
            else:
                out.append((chrom, qname, min(waiting, pos), max(waiting, pos), "paired"))
                waiting = None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update((waiting,))
            state.setTimeoutDuration(timeout_ms)
        if out:
            yield pd.DataFrame(out, columns=["chrom", "qname", "pos_a", "pos_b", "state"])

    return reads.select("chrom", "qname", "pos").groupBy("chrom", "qname").applyInPandasWithState(match, PAIR, "pos long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def depth_stream(reads: DataFrame) -> DataFrame:
    """Running counts of reads that start at each position; for output in update mode."""
    return reads.groupBy("chrom", "pos").agg(F.count("*").alias("n"))
