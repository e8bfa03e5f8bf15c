"""BAM in splits, by index and back; block gzip; proof of order."""

import json
import os
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.sources import bam, bgzf, order

CHROMS = [("c1", 10**6), ("chr2", 10**6)]


def invented(n, seed=1, long_every=499):
    """Sorted rows of COLUMNS, some longer than a block, some without bases, some unplaced."""
    r = random.Random(seed)
    rows, last, p = [], None, 1
    for i, chrom in enumerate(sorted((r.choice(["c1", "chr2", "*"]) for _ in range(n)), key=["c1", "chr2", "*"].index)):
        p = p + r.randrange(60) if chrom == last else 1
        last = chrom
        bases = r.choice([0, 1, 7, 36, 151]) if (i + 1) % long_every else 90_000
        seq = "".join(r.choice("ACGTN") for _ in range(bases)) or "*"
        mate = r.choice(["=", "*"]) if chrom != "*" else "*"
        qual = "*" if seq == "*" or r.random() < 0.3 else "".join(chr(33 + r.randrange(60)) for _ in range(bases))
        rows.append((f"q{i}", r.randrange(4096), chrom, p if chrom != "*" else 0, r.randrange(60), r.choice(["*", f"{max(bases, 1)}M", "5M2I3D4S", "3M400N3M"]), mate, r.randrange(9999), r.randrange(-300, 300), seq, qual))
    return rows


def along(cigar):
    return max(1, sum(int(n) for n, o in re.findall(r"(\d+)(\D)", cigar) if o in "MDN=X"))


def overlapping(rows, chrom, begin, end):
    return [r for r in rows if r[2] == chrom and r[3] - 1 < end and r[3] - 1 + along(r[5]) > begin]


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("bam") / "a.bam"), invented(2_000)
    with pa.OSFile(path, "wb") as f:
        e = bam.Encoder(f, CHROMS)
        for r in rows:
            e.add(*r)
        index = e.close()
    with open(path + ".bai", "wb") as f:
        f.write(index.packed())
    assert bam.parse_index(index.packed()) == index
    return path, rows


def read(path, split=1 << 30, region=None, filters=()):
    reader = bam.FilteredBamReader([path], region, split)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    parts = reader.partitions()
    return [tuple(x.values()) for p in parts for b in reader.read(p) for x in b.to_pylist()], parts


def test_every_split_gives_its_records(sample):
    path, rows = sample
    for size in (1 << 30, 150_000, 65_536, 9_973):
        got, parts = read(path, size)
        assert got == rows and len(parts) == -(-os.path.getsize(path) // size)


def test_small_splits_share_tasks(sample, monkeypatch):
    path, rows = sample
    monkeypatch.setattr(bam, "TASKS", 3)
    for size in (30_000, 9_973):
        got, parts = read(path, size)
        assert got == rows and 1 < len(parts) <= 5


def test_bases_and_scores_are_packed(tmp_path):
    seqs = ["ACGTN", "acgtn=", "", "*", "AÄ?T", "R" * 7]
    with pa.OSFile(str(tmp_path / "b.bam"), "wb") as f:
        e = bam.Encoder(f, CHROMS)
        for i, x in enumerate(seqs):
            e.add(f"q{i}", 0, "c1", i + 1, 0, None, None, 0, 0, x, "".join(chr(33 + k) for k in range(len(x))) if x != "*" else None)
        with pytest.raises(ValueError):
            e.add("q", 0, "c1", 9, 0, None, None, 0, 0, "A", " ")
        e.close()
    assert [r[9] for r in read(str(tmp_path / "b.bam"))[0]] == ["ACGTN", "ACGTN=", "*", "*", "ANNT", "R" * 7]


def test_the_order_is_told_in_one_pass(spark):
    n = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    rows = spark.range(1000).selectExpr("'f' AS file", "id div 100 AS start", "'c1' AS chrom", "id AS pos").repartition(3, "start").sortWithinPartitions("start", "pos").mapInArrow(seen, "file string, start long, chrom string, pos long")
    assert [tuple(r)[1:6] for r in order.report(rows, F.col("file"), F.col("start")).collect()] == [("c1", 1000, 0, 999, 0)] and n.value == 1000


def test_a_cut_at_every_block_gives_each_record_once(sample):
    path, rows = sample
    size = os.path.getsize(path)
    with bgzf.open_file(path) as f:
        places = [at for at, _ in bgzf.blocks(f, 0, size)]
        header = bam.read_header(f, size)
        reader = bam.BamReader([path], None, size)
        for at in places[1:]:
            for cut in (at, at - 1, at + 1):
                halves = [[x["qname"] for b in reader.read(bam.Part(path, b, e, False)) for x in b.to_pylist()] for b, e in ((0, cut), (cut, size))]
                assert sum(halves, []) == [r[0] for r in rows]
        assert bam.first_record(f, size, 0, header) == header.first and bam.first_record(f, size, size - 3, header) == size << 16


def test_a_wrong_guess_is_an_error(sample, monkeypatch):
    path, _ = sample
    true = bam.first_record
    monkeypatch.setattr(bam, "first_record", lambda f, size, start, header: true(f, size, start, header) + (7 if start else 0))
    with pytest.raises(ValueError, match="records go on at|damaged|within"):
        read(path, 150_000)


def test_regions_read_less(sample):
    path, rows = sample
    for region, place in {"2:100-9000": ("chr2", 99, 9000), "c1:5,000-5,001": ("c1", 4999, 5001), "chr2": ("chr2", 0, 1 << 29), "c1:15000": ("c1", 14_999, 1 << 29), "chr2:900000-900001": ("chr2", 899_999, 900_001)}.items():
        got, parts = read(path, region=region)
        assert got == overlapping(rows, *place)
        assert sum((p.end >> 16) - (p.begin >> 16) for p in parts) < 0.75 * os.path.getsize(path)
    assert read(path, region="chr7")[1] == []
    with pytest.raises(ValueError, match="not a region"):
        bam.parse_region("c1:9-3")


def test_regions_without_index(sample, tmp_path):
    path, rows = sample
    bare = tmp_path / "b.bam"
    bare.write_bytes(open(path, "rb").read())
    assert read(str(bare), 100_000, "chr2:100-9000")[0] == overlapping(rows, "chr2", 99, 9000)


def test_filters_choose_chunks(sample):
    path, rows = sample
    some = [bam.EqualTo(("chrom",), "chr2"), bam.GreaterThan(("pos",), 200), bam.LessThanOrEqual(("pos",), 400), bam.EqualTo(("mapq",), 3)]
    got, parts = read(path, filters=some)
    assert {r for r in rows if r[2] == "chr2" and 200 < r[3] <= 400} <= set(got) and sum((p.end >> 16) - (p.begin >> 16) for p in parts) < 0.5 * os.path.getsize(path)
    assert len(read(path, filters=[bam.EqualTo(("chrom",), "*")])[0]) == len(rows)  # unplaced reads have no bin
    assert read(path, filters=[bam.EqualTo(("chrom",), "2")])[0] == []


def test_bins():
    assert [bam.bin_of(0, 1), bam.bin_of(16_383, 16_385), bam.bin_of(0, 1 << 29), bam.bin_of(1 << 26, (1 << 26) + 1)] == [4681, 585, 0, 4681 + 4096]
    g = random.Random(2)
    for _ in range(300):
        a, b = g.randrange(1 << 22), g.randrange(1 << 22)
        x, y = (a, a + g.randrange(1, 40_000)), (b, b + g.randrange(1, 40_000))
        if x[0] < y[1] and y[0] < x[1]:
            assert bam.bin_of(*x) in bam.bins_over(*y)


def test_blocks(tmp_path):
    noise = random.Random(3).randbytes(bgzf.FILL)
    for data in (b"", b"a", b"\0" * bgzf.FILL, noise):
        block = bgzf.deflated(data)
        assert bgzf.block_size(block) == len(block) <= bgzf.MOST and bgzf.inflated(block) == data and zlib.decompress(block, 31) == data
    assert bgzf.inflated(bgzf.END) == b"" and bgzf.block_size(bgzf.END) == len(bgzf.END)
    # bytes that look like a block, inside of one
    trap = bgzf.deflated(noise[: bgzf.FILL - 100] + bgzf.END[:20] * 3)
    (tmp_path / "x").write_bytes(trap * 4 + bgzf.END)
    with bgzf.open_file(str(tmp_path / "x")) as f:
        size = f.size()
        assert [bgzf.next_block(f, k, size) for k in (0, 1, len(trap), len(trap) * 4 + 1)] == [0, len(trap), len(trap), size]
    (tmp_path / "y").write_bytes(trap[:-5])
    with bgzf.open_file(str(tmp_path / "y")) as f, pytest.raises(ValueError, match="within a block"):
        list(bgzf.blocks(f, 0, f.size()))


# -- through Spark


def table(spark, rows):
    return spark.createDataFrame(rows, bam.COLUMNS)


@pytest.fixture(scope="module")
def chroms(spark):
    return spark.createDataFrame(CHROMS, "chrom string, length long")


def test_sorted_parts_and_back(spark, tmp_path, chroms):
    rows = invented(1_500, 5)
    mixed = random.Random(1).sample(rows, len(rows))
    out = str(tmp_path / "out")
    bam.write_bam(table(spark, mixed).repartition(3), out, chroms, parts=4)
    names = sorted(os.listdir(out))
    parts = [n for n in names if n.endswith(".bam")]
    assert len(parts) == 4 and "_SUCCESS" in names and not [n for n in names if n.startswith("_temporary")] and all(f"{n}.bai" in names for n in parts)
    got = bam.read_bam(spark, out, split_bytes=50_000)
    assert sorted(tuple(r)[:-1] for r in got.collect()) == sorted(rows)
    assert {(r.chrom, r.n, r.breaks) for r in order.checked(got).collect()} == {(c, sum(x[2] == c for x in rows), 0) for c in ("c1", "chr2", "*")}
    assert sorted(r.qname for r in bam.read_bam(spark, out, region="2:100-9000").collect()) == sorted(r[0] for r in overlapping(rows, "chr2", 99, 9000))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        near = spark.read.format("bam").option("pushFilters", "true").load(out).where("chrom = 'chr2' AND pos >= 100 AND pos < 900")
        assert sorted(r.qname for r in near.collect()) == sorted(r[0] for r in rows if r[2] == "chr2" and 100 <= r[3] < 900)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    bam.write_bam(table(spark, rows[:5]), out, chroms, mode="append")
    assert bam.read_bam(spark, out).count() == 1_505
    bam.write_bam(table(spark, rows[:5]), out, chroms, mode="overwrite")
    assert bam.read_bam(spark, out).count() == 5
    bam.write_bam(table(spark, rows[:0]), str(tmp_path / "none"), chroms)
    assert bam.read_bam(spark, str(tmp_path / "none")).count() == 0


def test_reads_of_one_place_are_dealt_out(spark, chroms):
    row = invented(1)[0]
    many = table(spark, [(f"n{i}", 0, "c1", 7, *row[4:]) for i in range(4_000)])
    sizes = [r[0] for r in bam.in_order(many, chroms, 4).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) < 2_000


def test_a_failed_write_leaves_nothing(spark, tmp_path, chroms):
    rows = invented(200, 6)
    broken = [*rows[:150], (*rows[150][:2], "c9", *rows[150][3:]), *rows[151:]]
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="not a chromosome of the header"):
        table(spark, broken).repartition(3).write.format("bam").option("chroms", json.dumps(CHROMS)).mode("append").save(out)
    assert not os.path.exists(out) or os.listdir(out) == []


# -- order


def breaks(spark, rows, parts, **more):
    df = spark.createDataFrame(rows, "chrom string, pos long").coalesce(1).repartition(1)
    assert df.count() == len(rows)
    size = -(-len(rows) // parts)
    numbered = spark.createDataFrame([(i // size, c, p) for i, (c, p) in enumerate(rows)], "part long, chrom string, pos long").coalesce(1)
    return {r.chrom: (r.n, r.first_pos, r.last_pos, r.breaks, r.broken_at) for r in order.report(numbered, F.lit("f"), F.col("part"), **more).collect()}


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_breaks_of_order(spark, parts):
    fine = [("a", 1), ("a", 1), ("a", 5), ("b", 2), ("b", 9), ("c", 1), ("c", 1)]
    assert breaks(spark, fine, parts) == {"a": (3, 1, 5, 0, None), "b": (2, 2, 9, 0, None), "c": (2, 1, 1, 0, None)}
    assert {c: v[3] for c, v in breaks(spark, fine, parts, strict=True).items()} == {"a": 1, "b": 0, "c": 1}
    back = [("a", 1), ("a", 7), ("a", 3), ("a", 4), ("b", 2), ("a", 9), ("b", 3)]
    got = breaks(spark, back, parts)
    assert got["a"][3:] == (2, 3) and got["b"][3:] == (1, 3)


def test_unsorted_files_are_an_error(spark):
    df = spark.createDataFrame([("a", 5), ("a", 4)], "chrom string, pos long").coalesce(1)
    with pytest.raises(Exception, match="not sorted.*a at 4"):
        order.checked(df).collect()
