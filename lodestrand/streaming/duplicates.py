"""Removal of duplicates from a stream of reads that comes in order of place, or nearly so.

The place is the event time: the bases of all chromosomes, one after another,
count as seconds.  Reads wait in the state of the BIN places that theirs (for
pairs, the right one) is among until the watermark has passed them; a timer
then keeps one of each group by hash: the one that the batch operators in
`operators.remap` keep.  State goes with it, so what is held is what lies
within `delay` bases of the furthest read, or waits for a mate further on.

The last groups go out when something beyond them comes.  Unplaced reads, which
follow all others in a sorted file, do this; where a source has none, it ends
with a row from end_mark().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.classify import duplicate_disposition, is_plain_single

#: State with timers is kept in RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Places whose reads share a state: each costs some calls from Python.
BIN = 64


def offsets(chroms: DataFrame, delay: int) -> list[tuple[str, int]]:
    """Where each chromosome (a row of chroms: chrom, length, in their order) begins among all bases; the end of all is named *."""
    out, at = [], 0
    for name, length in chroms.select("chrom", "length").collect():  # a chromosome table is small
        out.append((name, at))
        at += length + 1
    return [*out, ("*", at + BIN + delay + 2)]


def event_time(places: list[tuple[str, int]], chrom: Column, pos: Column) -> Column:
    """The place of a read as a time; unplaced ones come after all others."""
    begin = F.lit(None).cast("long")
    for name, at in places:  # few names: chromosomes, and the end
        begin = F.when(chrom == name, F.lit(at)).otherwise(begin)
    end = places[-1][1]
    return F.timestamp_seconds(F.coalesce(begin + F.when(chrom == "*", 0).otherwise(pos), F.lit(end)))


def end_mark(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """One unplaced, unmapped row of the schema, to end a stream with."""
    row = {"qname": "*" if schema["qname"].dataType == T.StringType() else -1, "flag": 4, "chrom": "*", "pos": 0}
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema)], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


class Keeper(StatefulProcessor):
    """Holds the reads of some places until their time has passed, then gives one read, or both reads of one pair, of each group."""

    def __init__(self, schema: T.StructType, pairs: bool, seed: int):
        self.fields, self.pairs, self.seed = schema, pairs, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[-1] < 0:  # these take no part
            return
        n, due = len(self.fields.names), None
        for some in rows:  # by place: names are not what they were; the last column is when the places have passed
            due = some.iloc[0, -1]
            plain = some.iloc[:, :n].astype(object)
            self.held.appendList([tuple(None if pd.isna(v) else v for v in r) for r in plain.itertuples(index=False)])
        if due is not None:
            self.handle.registerTimer(int(pd.Timestamp(due).timestamp() * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = list(self.held.get())
        self.held.clear()
        at = {c: i for i, c in enumerate(self.fields.names)}
        groups: dict[tuple, dict] = {}
        for r in rows:
            pos = r[at["pos"]]
            group = (min(pos, r[at["mate_pos"]]), max(pos, r[at["mate_pos"]])) if self.pairs else (pos, r[at["flag"]])
            groups.setdefault(group, {}).setdefault(r[at["qname"]], []).append(r)
        out = []
        for by_name in groups.values():
            whole = [n for n, own in by_name.items() if not self.pairs or len(own) == 2]
            if whole:
                chosen = min(whole, key=lambda n: (hashlib.md5(f"{n}|{self.seed}".encode()).hexdigest(), n))
                out += by_name[chosen] if self.pairs else by_name[chosen][:1]
        if out:
            yield pd.DataFrame(out, columns=list(self.fields.names))

    def close(self) -> None:
        pass


def _kept(reads: DataFrame, chroms: DataFrame, delay: int, by: tuple[str, ...], takes_part: Column, last: Column, pairs: bool, seed: int) -> DataFrame:
    """Reads that are kept of a stream; last: the position that ends a read's group.

    Rows that take no part are not filtered out, as Spark would do that before
    it takes the watermark from them; they go to groups that hold nothing.
    """
    places = offsets(chroms, delay)
    timed = reads.withColumn("_time", event_time(places, F.col("chrom"), F.col("pos"))).withWatermark("_time", f"{delay + 1} seconds")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in reads.schema])
    bin_ = F.floor(last / BIN).cast("long")
    keyed = timed.withColumns({"_bin": F.when(F.coalesce(takes_part, F.lit(False)), bin_).otherwise(-1 - F.pmod(F.xxhash64("qname"), F.lit(256))), "_due": event_time(places, F.col("chrom"), bin_ * BIN + BIN - 1)})
    return keyed.groupBy(*by, "chrom", "_bin").transformWithStateInPandas(Keeper(schema, pairs, seed), schema, "Append", "EventTime")


def replayed(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, keep, files: int | None = None) -> DataFrame:
    """What keep makes of the stream of a folder's Parquet files, taken as they were written, so many a batch; written to target and read.

    A replay that was stopped goes on from its checkpoint when called again.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stream = spark.readStream.schema(schema)
    out = keep((stream.option("maxFilesPerTrigger", files) if files else stream).parquet(source))
    spark.conf.set(name, STATE_STORE)  # a query takes it when it starts
    try:
        out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(target)


def dedup_single_stream(reads: DataFrame, chroms: DataFrame, delay: int = 1_000, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """dedup_single() of a stream: qname, flag, chrom, pos and further columns, at most delay bases out of order.

    Positions are 1 or more.  What comes later than delay bases behind is left out, as Spark drops it.
    """
    return _kept(reads, chroms, delay, by, is_plain_single() & (F.col("pos") >= 0), F.col("pos"), False, seed)


def dedup_pairs_stream(reads: DataFrame, chroms: DataFrame, delay: int = 1_000, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """dedup_pairs() of a stream: qname, flag, chrom, pos, mate_chrom, mate_pos and further columns, at most delay bases out of order.

    A group waits until the place of its right reads has been passed.
    """
    left, right = F.least("pos", "mate_pos"), F.greatest("pos", "mate_pos")
    good = (duplicate_disposition(F.col("mate_chrom") == F.col("chrom")) == "paired") & (left >= 0)
    return _kept(reads, chroms, delay, by, good, right, True, seed)
