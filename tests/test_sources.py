"""Files read into tables and written from them."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrand.sources import chrom, fasta, impute, sam, tables, vcf


def put(path, text, zipped=False):
    (gzip.open if zipped else open)(path, "wt").write(text)
    return str(path)


def test_chromosomes(spark, tmp_path):
    p = put(tmp_path / "c.txt.gz", "chr2\t50\tx\nchr10\t40\nchrX\t30\nchrM\t5\nchr6_hap1\t7\n", True)
    rows = chrom.read_chromosomes(spark, p)
    assert [r.chrom for r in rows.orderBy("idnum").collect()] == ["chr2", "chr10", "chrX", "chrM", "chr6_hap1"]
    assert {r.chrom for r in chrom.choose(rows).collect()} == {"chr2", "chr10", "chrX"}
    with pytest.raises(Exception, match="length"):
        chrom.read_chromosomes(spark, put(tmp_path / "bad.txt", "chr1\t0\n")).collect()
    guess = chrom.guessed(spark.createDataFrame([("/x/chr10.vcf",), ("none",)], "path string"), spark.createDataFrame([("chr1", 1), ("chr10", 1)], "chrom string, length long"))
    assert [r.chrom for r in guess.collect()] == ["chr10", None]


def test_vcf(spark, tmp_path):
    head = "##x\n\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    p = put(tmp_path / "v.vcf", head + "1\t5\trs1\tA\tC\t.\t.\t.\tGT:GL\t0|1:-1,-0.1,-2\t./.:.\n1\t9\trs2\tA\tC,T\t.\t.\t.\tGT:GP:PL\t1/0:0.1,0.8,0.1:0,10,20\t0|2:0.5,0.5,0.5:0,10,20\n1\t11\trs3\tG\tT\t.\t.\t.\tGT:PL\t1|1:20,10,0\t0/0:0,10,20\n")
    assert vcf.read_samples(spark, p) == ["s1", "s2"]
    chroms = spark.createDataFrame([("chr1", 100)], "chrom string, length long")
    g = {(r.pos, r.sample): r for r in vcf.read_genotypes(spark, p, chroms).collect()}
    assert (g[5, "s1"].chrom, g[5, "s1"].hap1, g[5, "s1"].hap2, g[5, "s1"].phased) == ("chr1", 0, 1, True)
    assert g[5, "s2"].hap1 is None and abs(g[5, "s2"].p_rr - 1 / 3) < 1e-6
    assert not g[9, "s1"].phased and abs(g[9, "s1"].p_ra - 0.8) < 1e-6
    assert g[9, "s2"].hap1 is None and abs(g[9, "s2"].p_rr - 1 / 3) < 1e-6
    assert abs(g[11, "s1"].p_aa - 1 / 1.11) < 1e-5
    assert vcf.read_lines(spark, p, max_lines=1).count() == 1
    with pytest.raises(Exception, match="outside"):
        vcf.read_variants(spark, p, spark.createDataFrame([("chr1", 6)], "chrom string, length long")).collect()


def test_impute(spark, tmp_path):
    a = put(tmp_path / "chr7.impute2", "--- rs1 5 A C 0.9 0.1 0 0 0 1\n--- rs2 8 G T 1 0 0 1 0 0\n")
    b = put(tmp_path / "chr7.impute2_haps", "--- rs1 5 A C 0 1 1 1\n--- rs9 6 A C 0 0 0 0\n")
    out = impute.with_haplotypes(impute.read_probabilities(spark, a, ["x", "y"]), impute.read_haplotypes(spark, b, ["x", "y"]))
    got = {(r.chrom, r.pos, r.sample): (r.hap1, r.hap2) for r in out.collect()}
    assert got == {("chr7", 5, "x"): (0, 1), ("chr7", 5, "y"): (1, 1), ("chr7", 8, "x"): (None, None), ("chr7", 8, "y"): (None, None)}
    with pytest.raises(Exception, match="probabilities"):
        impute.read_probabilities(spark, a, ["x"]).collect()


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "g.fa", ">c1 note\nACGT\nAC\n>c2\nTT\n")
    chunks = fasta.read_fasta(spark, p, chunk=4)
    assert sorted((r.chrom, r.chunk_start, r.bases) for r in chunks.collect()) == [("c1", 1, "ACGT"), ("c1", 5, "AC"), ("c2", 1, "TT")]
    assert {r.value for r in fasta.fasta_text(chunks, 5).collect()} == {">c1\nACGTA\nC", ">c2\nTT"}


SAM = "@HD\tVN:1.0\n@SQ\tSN:c1\tLN:100\nr1\t67\tc1\t5\t60\t4M\t=\t20\t19\tACGT\tIIII\tNM:i:0\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n"


def bam_bytes():
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100)

    def record(name, flag, ref, pos, mapq, ops, next_ref, next_pos, tlen, seq, qual):
        codes = [sam.BASES.index(c) for c in seq]
        codes += [0] * (len(codes) % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), next_ref, next_pos, tlen) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | sam.OPERATIONS.index(o)) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual
        return struct.pack("<i", len(body)) + body

    parts = [head, record("r1", 67, 0, 4, 60, [(4, "M")], 0, 19, 19, "ACGT", bytes([40] * 4)), record("r2", 4, -1, -1, 0, [], -1, -1, 0, "AC", b"\xff\xff")]
    zipped = b""
    for x in parts:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        zipped += c.compress(x) + c.flush()
    return zipped


def test_sam_and_bam_agree(spark, tmp_path):
    text = sam.read_sam(spark, put(tmp_path / "a.sam", SAM)).orderBy("qname").collect()
    (tmp_path / "a.bam").write_bytes(bam_bytes())
    assert sam.read_bam(spark, str(tmp_path / "a.bam")).orderBy("qname").collect() == text
    spark.dataSource.register(sam.BamSource)
    assert spark.read.format("bam").load(str(tmp_path / "a.bam")).count() == 2
    assert sam.sam_text(sam.read_sam(spark, str(tmp_path / "a.sam"))).orderBy("value").first().value.startswith("r1\t67\tc1\t5\t60\t4M\t=\t20\t19\tACGT\tIIII")
    assert sam.on_chromosome(spark.createDataFrame([("chr1",), ("1",), ("2",)], "chrom string"), "chr1").count() == 2


def test_snp_lists(spark, tmp_path):
    p = put(tmp_path / "c1.snps.txt.gz", "10 a -\n20 A ATTG\n", True)
    rows = tables.read_snps(spark, p)
    assert sorted((r.chrom, r.pos, r.allele1, r.allele2) for r in rows.collect()) == [("c1", 10, "A", ""), ("c1", 20, "A", "ATTG")]
    tables.write_snps(rows, str(tmp_path / "out"))
    assert {r.value for r in spark.read.text(str(tmp_path / "out" / "chrom=c1")).collect()} == {"10 A -", "20 A ATTG"}
    with pytest.raises(Exception, match="not a variant"):
        tables.read_snps(spark, put(tmp_path / "c2.snps.txt", "0 A C\n")).collect()


def test_lists_of_values(spark, tmp_path):
    assert tables.read_names(spark, put(tmp_path / "n", "a x\nb\n")) == ["a", "b"]
    with pytest.raises(ValueError, match="repeated"):
        tables.read_names(spark, put(tmp_path / "m", "a\na\n"))
    p = put(tmp_path / "v", "0.1\n0.2\n")
    assert {r.individual: r.disp for r in tables.read_values(spark, p, ["a", "b"], 0, 1).collect()} == {"a": 0.1, "b": 0.2}
    with pytest.raises(ValueError, match="bounds"):
        tables.read_values(spark, p, ["a", "b"], 0.15)
    assert tables.read_covariates(spark, put(tmp_path / "w", "1 2 3\n4 5 6\n"), ["a", "b"], 2).orderBy("individual").first()["values"] == [1.0, 2.0]


def test_rows_of_the_test_go_both_ways(spark, tmp_path):
    line = "chr1 963531 rs1 A G 1.00 0|1 963155 965155 963199;963240 1.00;0.90 1.00;1.00 0;2 0;1 0;0 20 26219310.00"
    p = put(tmp_path / "i.txt", " ".join(tables.INPUT_COLUMNS) + "\n" + line + "\nchr1 5 NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA\n")
    rows = tables.read_input(spark, {"a": p})
    assert rows.where("test_pos = 963531").first().region_snps[1].ref_n == 2
    assert rows.where("test_pos = 5").first().region_reads is None
    assert tables.input_text(rows.where("test_pos = 963531")).first().value == line


def test_fastq(spark):
    v = spark.createDataFrame([("n", "AACG", "IIIJ", "TTTG", "JIII")], "name string, seq_a string, qual_a string, seq_b string, qual_b string")
    a, b = tables.fastq_pair(v)
    assert a.first().value == "@n\nAACG\n+\nIIIJ" and b.first().value == "@n\nCAAA\n+\nJIII"
    assert a.select(F.size(F.split("value", "\n"))).first()[0] == 4


def test_fasta_in_many_splits(spark, tmp_path):
    import random

    g = random.Random(1)
    seqs = {f"c{i}": "".join(g.choice("ACGT") for _ in range(n)) for i, n in enumerate((5_000, 1, 12_345, 777))}
    for i, own in enumerate((("c0", "c1"), ("c2", "c3"))):
        put(tmp_path / f"{i}.fa", "".join(f">{c} x\n" + "".join(seqs[c][k : k + 61] + "\n" for k in range(0, len(seqs[c]), 61)) for c in own))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        lengths = spark.createDataFrame([(c, len(x)) for c, x in seqs.items()], "chrom string, length long")
        chunks = fasta.read_fasta(spark, str(tmp_path), 100, lengths)
        assert chunks.rdd.getNumPartitions() >= 1
        got = {(r.chrom, r.chunk_start): r.bases for r in chunks.collect()}
        with pytest.raises(ValueError, match="as long as"):
            fasta.read_fasta(spark, str(tmp_path), 100, lengths.where("chrom = 'c1'").withColumn("length", F.lit(2).cast("long")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(c, k + 1): x[k : k + 100] for c, x in seqs.items() for k in range(0, len(x), 100)}
    lines = [r.value for r in fasta.fasta_lines(spark.createDataFrame([(c, k, b) for (c, k), b in got.items()], "chrom string, chunk_start long, bases string"), 70).collect()]
    assert lines == [y for c in sorted(seqs) for y in [f">{c}", *(seqs[c][k : k + 70] for k in range(0, len(seqs[c]), 70))]]


def test_gzip_is_told_by_its_first_bytes(spark, tmp_path):
    from lodestrand.sources import streams

    put(tmp_path / "a.txt", "x\ny\n", True)
    put(tmp_path / "b.gz.not", "p\nq\nr")
    (tmp_path / "c.txt").write_bytes(gzip.compress(b"1\n2") + gzip.compress(b"3\n"))
    got = {(r.path.rsplit("/", 1)[-1], r.line, r.value) for r in streams.read_lines(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 1, "x"), ("a.txt", 2, "y"), ("b.gz.not", 1, "p"), ("b.gz.not", 2, "q"), ("b.gz.not", 3, "r"), ("c.txt", 1, "1"), ("c.txt", 2, "23")}
    assert {r.lines for r in streams.count_lines(spark, str(tmp_path)).collect()} == {2, 3}


def test_bam_of_many_blocks_and_damage(spark, tmp_path):
    from lodestrand.sources import streams

    data = bam_bytes()
    (tmp_path / "a.bam").write_bytes(data)
    raw = b"".join(streams.pieces(f"file://{tmp_path}/a.bam"))
    assert list(sam.parse_bam(iter([raw[i : i + 7] for i in range(0, len(raw), 7)]))) == list(sam.parse_bam(iter([raw])))
    with pytest.raises(ValueError, match="ends within"):
        list(sam.parse_bam(iter([raw[:-3]])))
    (tmp_path / "b.bam").write_bytes(data[:-5])
    with pytest.raises(ValueError, match="ends within"):
        list(streams.pieces(f"file://{tmp_path}/b.bam"))


def test_files_of_a_chromosome_are_paired():
    chroms = ["chr1", "chr11", "chrX"]
    assert impute.paired_files(["/a/chr11.x.gz", "/a/chr1.x"], ["/b/chr1_h", "/b/chr11_h"], chroms) == [("chr1", "/a/chr1.x", "/b/chr1_h"), ("chr11", "/a/chr11.x.gz", "/b/chr11_h")]
    with pytest.raises(ValueError, match="partner"):
        impute.paired_files(["chr1"], ["chrX"], chroms)
    with pytest.raises(ValueError, match="second"):
        impute.paired_files(["chr1.a", "chr1.b"], ["chr1"], chroms)


def test_unknown_chromosomes_may_be_refused(spark):
    rows = spark.createDataFrame([("9", 5)], "chrom string, pos long")
    chroms = spark.createDataFrame([("chr1", 100)], "chrom string, length long")
    assert vcf.placed(rows, chroms).count() == 0
    with pytest.raises(Exception, match="unknown chromosome"):
        vcf.placed(rows, chroms, strict=True).collect()
