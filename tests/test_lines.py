"""Text lines in splits, with their numbers; files of individuals line by line together."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.sources import bgzf, lines, order, tables, vcf


def block_file(path, text, cuts=()):
    """A file of block gzip whose blocks end at some places of the text, and after every 60,000 bytes."""
    data, at = text.encode(), 0
    out = b""
    for cut in [*sorted(cuts), len(data)]:
        while at < cut:
            end = min(cut, at + 60_000)
            out += bgzf.deflated(data[at:end])
            at = end
    path.write_bytes(out + bgzf.END)
    return str(path)


def numbered(spark, path, size):
    return [r.value for r in lines.numbered(lines.block_lines(spark, path, size)).orderBy("file", "line").collect()]


@pytest.mark.parametrize("end", ["", "\n"])
def test_lines_of_one_file_in_many_tasks(spark, tmp_path, end):
    g = random.Random(1)
    want = ["".join(g.choice("abcdé") for _ in range(g.choice([0, 3, 40, 40, 200]))) for _ in range(3_000)] + ["last"]
    text = "\n".join(want) + end
    raw = text.encode()
    newlines = [i for i, c in enumerate(raw) if c == 10]
    cuts = [*(n + 1 for n in newlines[::150]), *newlines[75::150]]  # at a line's first byte, and before a newline
    path = block_file(tmp_path / "a.any", text, cuts)
    df = lines.block_lines(spark, path, 3_000)
    assert df.rdd.getNumPartitions() > 10 and df.select("start").distinct().count() > 5
    for size in (700, 3_000, 1 << 20):
        assert numbered(spark, path, size) == want


def test_long_lines_and_empty_files(spark, tmp_path):
    long = ["x" * 150_000, "", "y" * 70_000]
    assert numbered(spark, block_file(tmp_path / "a", "\n".join(long) + "\n"), 100) == long
    assert numbered(spark, block_file(tmp_path / "b", ""), 100) == []
    (tmp_path / "c.txt").write_bytes(gzip.compress(b"one\ntwo"))
    (tmp_path / "d.gz").write_text("three\nfour\n")
    assert numbered(spark, str(tmp_path / "c.txt"), 5) == ["one", "two"] and numbered(spark, str(tmp_path / "d.gz"), 5) == ["three", "four"]


def test_numbers_and_first_lines_of_text(spark, tmp_path):
    for name, n in (("a", 5_000), ("b", 7)):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = lines.text_lines(spark, str(tmp_path))
        assert df.select("file", "start").distinct().count() > 5
        assert sorted((r.value[0], r.line) for r in lines.numbered(df).where("value <> concat(substr(file, -1), line)").collect()) == []
        for n in (0, 3, 7, 2_000, 5_000, 9_000):
            got = [r.value for r in lines.first_lines(df, n).collect()]
            assert sorted(got) == sorted([f"a{i}" for i in range(min(n, 5_000))] + [f"b{i}" for i in range(min(n, 7))])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n" + "".join(f"chr1\t{i}\trs{i}\tA\tC\t.\t.\t.\tGT\t0|1\n" for i in range(1, 401))


def test_vcf_in_blocks(spark, tmp_path):
    path = block_file(tmp_path / "v.vcf.gz", VCF, range(100, 9_000, 500))
    (tmp_path / "plain.vcf").write_text(VCF)
    plain = str(tmp_path / "plain.vcf")
    assert sorted(map(tuple, vcf.read_genotypes(spark, path, in_blocks=True).collect())) == sorted(map(tuple, vcf.read_genotypes(spark, plain).collect()))
    for n in (1, 250):
        for p, blocks in ((path, True), (plain, False)):
            assert sorted(r.pos for r in vcf.read_lines(spark, p, n, blocks).collect()) == list(range(1, n + 1))
    with pytest.raises(Exception, match="unknown chromosome"):
        vcf.read_genotypes(spark, plain, spark.createDataFrame([("chr2", 9)], "chrom string, length long"), strict=True).collect()


def test_written_blocks_are_in_order(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(30_000, numPartitions=2).select(F.format_string("chr1\t%d", "id").alias("value"))
    lines.write_blocks(df, out, header="#h")
    got = lines.block_lines(spark, out, 4_096).where("value <> '#h'")
    assert got.count() == 30_000
    p = F.split("value", "\t")
    placed = got.select("file", "start", p[0].alias("chrom"), p[1].cast("long").alias("pos"))
    assert {r.breaks for r in order.report(placed, F.col("file"), F.col("start")).collect()} == {0}


LINE = "chr1 {pos} rs1 A G 1.00 0|1 963155 965155 963199;963240 1.00;0.90 1.00;1.00 0;2 0;1 0;0 20 26219310.00"


def individual(tmp_path, name, places):
    p = tmp_path / name
    p.mkdir()
    half = len(places) // 2
    for i, own in enumerate((places[:half], places[half:])):
        text = (" ".join(tables.INPUT_COLUMNS) + "\n" if i == 0 else "") + "".join(LINE.format(pos=x) + "\n" for x in own)
        (p / f"part-{i}").write_text(text)
    return str(p)


def test_individuals_line_by_line(spark, tmp_path):
    places = list(range(100, 160))
    files = {n: individual(tmp_path, n, places) for n in ("a", "b", "c d")}
    got = tables.read_aligned_input(spark, files)
    assert sorted((r.individual, r.row, r.test_pos) for r in got.collect()) == sorted((n, i + 1, x) for n in files for i, x in enumerate(places))
    plan = tables.read_input(spark, files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0
    swapped = places[:20] + [places[21], places[20]] + places[22:]
    with pytest.raises(ValueError, match="row 21: chr1:12[01]"):
        tables.read_aligned_input(spark, files | {"e": individual(tmp_path, "e", swapped)})
    with pytest.raises(ValueError, match="row 60: 3 of 4"):
        tables.read_aligned_input(spark, files | {"f": individual(tmp_path, "f", places[:-1])})
