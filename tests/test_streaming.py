"""Duplicates of a stream: the same as in a batch, however the stream is cut."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import remap
from lodestrand.streaming import duplicates

READS = "qname string, flag int, chrom string, pos long, mate_chrom string, mate_pos long, seq string"


def invented(n, seed):
    """Sorted reads of pairs that share places, some without mate, some not proper, and single reads."""
    g, rows = random.Random(seed), []
    for i in range(n):
        chrom, left = g.choice(["c1", "c2"]), g.randrange(1, 40)
        right = left + g.choice([0, 3, 60])
        flags = g.choice([(67, 131), (67, 131), (83, 163), (65, 129), (73, 133)])
        rows.append((f"n{i}", flags[0], chrom, left, chrom, right, "A"))
        if g.random() < 0.9:
            rows.append((f"n{i}", flags[1], chrom, right, chrom, left, "C"))
        rows.append((f"s{i}", g.choice([0, 16, 4, 256]), chrom, left, "*", 0, "G"))
    return sorted(rows, key=lambda r: (r[2], r[3]))


def hash_of(name):
    return zlib.crc32(name.encode()) % 5


def replay(spark, tmp_path, rows, cuts, keep, delay):
    source = tmp_path / "in"
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        if b > a:
            spark.createDataFrame(rows[a:b], READS).coalesce(1).write.mode("append").parquet(str(source))
            time.sleep(0.02)  # files are taken in the order of their times
    schema = spark.createDataFrame([], READS).schema
    duplicates.end_mark(spark, schema).write.mode("append").parquet(str(source))
    chroms = spark.createDataFrame([("c1", 200), ("c2", 200)], "chrom string, length long")
    got = duplicates.replayed(spark, str(source), schema, str(tmp_path / "out"), str(tmp_path / "ck"), lambda s: keep(s, chroms, delay), files=1)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("cuts, delay", [((), 0), ((30, 31, 60), 0), ((5, 100), 5)])
def test_pairs_equal_the_batch(spark, tmp_path, cuts, delay):
    rows = invented(60, len(cuts))
    if delay:  # neighbours out of order
        rows = sorted(rows, key=lambda r: (r[2], r[3] + hash_of(r[0])))
    want = sorted(tuple(r) for r in remap.dedup_pairs(spark.createDataFrame(rows, READS)).select(*[c.split()[0] for c in READS.split(", ")]).collect())
    got = replay(spark, tmp_path, rows, cuts, duplicates.dedup_pairs_stream, delay)
    assert want and (set(got) - set(want), set(want) - set(got)) == (set(), set()) and got == want


def test_single_reads_equal_the_batch(spark, tmp_path):
    rows = invented(60, 9)
    want = sorted(tuple(r) for r in remap.dedup_single(spark.createDataFrame(rows, READS)).collect())
    assert replay(spark, tmp_path, rows, (40, 90), duplicates.dedup_single_stream, 0) == want and want


def test_the_last_group_waits_for_an_end(spark, tmp_path):
    rows = [("a", 0, "c1", 5, "*", 0, "A"), ("b", 0, "c1", 9, "*", 0, "A")]
    spark.createDataFrame(rows, READS).coalesce(1).write.parquet(str(tmp_path / "in"))
    chroms = spark.createDataFrame([("c1", 50)], "chrom string, length long")
    keep = lambda s: duplicates.dedup_single_stream(s, chroms, 0)
    schema = spark.createDataFrame([], READS).schema
    places = str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck")
    assert "b" not in {r.qname for r in duplicates.replayed(spark, *places, keep).collect()}
    duplicates.end_mark(spark, schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert {r.qname for r in duplicates.replayed(spark, *places, keep).collect()} == {"a", "b"}  # goes on from its checkpoint


def test_places_as_times(spark):
    chroms = spark.createDataFrame([("c1", 10), ("c2", 20)], "chrom string, length long")
    places = duplicates.offsets(chroms, 5)
    df = spark.createDataFrame([("c1", 1), ("c1", 10), ("c2", 1), ("c2", 20), ("*", 0), (None, None)], "chrom string, pos long")
    times = [r[0] for r in df.select(F.unix_seconds(duplicates.event_time(places, F.col("chrom"), F.col("pos")))).collect()]
    assert times[:4] == sorted(set(times[:4])) and times[4] == times[5] and times[4] - times[3] > 5
