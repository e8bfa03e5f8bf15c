"""Golden cases of reads, variants and versions, and properties against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import alleles, cigar, coords, seq
from lodestrand.operators import counts, overlap, remap, split
from lodestrand.sources import chrom as chroms

SNPS = [("c1", 10, "A", "C"), ("c1", 20, "T", "G"), ("c1", 100, "A", "T")]
READ = "qname string, flag int, chrom string, pos long, cigar string, seq string"


def snps(spark, rows):
    return spark.createDataFrame([(c, p, i, a, b) for i, (c, p, a, b) in enumerate(rows)], "chrom string, pos long, snp_idx long, allele1 string, allele2 string")


def reads(spark, *rows):
    return spark.createDataFrame([(q, 0, c, p, g, s) for q, c, p, g, s in rows], READ)


@pytest.mark.parametrize("text, expected", [("30M", [(0, 10), (1, 20)]), ("10M85N20M", [(0, 10), (2, 15)]), ("10S20M", [(0, 20), (1, 30)])])
def test_overlap(spark, text, expected):
    got = overlap.read_variants(reads(spark, ("r", "c1", 1, text, "A" * 30)), snps(spark, SNPS)).orderBy("site").collect()
    assert [(r.snp_idx, r.read_pos) for r in got] == expected


def test_indel_in_a_deletion_counts_and_snp_does_not(spark):
    got = overlap.read_variants(reads(spark, ("r", "c1", 1, "5M10D20M", "A" * 25)), snps(spark, [("c1", 8, "A", "C"), ("c1", 9, "A", "")])).collect()
    assert [(r.site, r.is_snp, r.base) for r in got] == [(9, False, None)]


def walk(pos, text, deleted):
    out, g, r = [], pos, 1
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", text)):
        if op in "M=X" or deleted and op == "D":
            out.append((g, g + n - 1, r, op))
        g += n if op in "MDN=X" else 0
        r += n if op in "MIS=X" else 0
    return out


def test_blocks_equal_a_plain_walk(spark):
    rnd = random.Random(3)
    rows = [("".join(f"{rnd.randint(1, 9)}{rnd.choice('MIDNSHP=X')}" for _ in range(rnd.randint(1, 7))),) for _ in range(200)]
    df = spark.createDataFrame(rows, "c string")
    for deleted in (False, True):
        for r in df.select("c", cigar.blocks(F.lit(5), F.col("c"), deleted).alias("b")).collect():
            assert [tuple(x) for x in r.b] == walk(5, r.c, deleted)


def test_versions_of_one_site(spark):
    r, v = split.split_single(reads(spark, ("r", "c1", 1, "30M", "A" * 30), ("s", "c2", 1, "30M", "A" * 30)), snps(spark, [("c1", 1, "A", "C")]))
    assert {x.qname: x.disposition for x in r.collect()} == {"r": "remap", "s": "keep"}
    assert [(x.name, x.seq) for x in v.collect()] == [("r.1.1.1", "C" + "A" * 29)]


def test_indel_and_limits(spark):
    r, v = split.split_single(reads(spark, ("r", "c1", 1, "30M", "A" * 30)), snps(spark, [("c1", 2, "A", "CCC")]))
    assert [x.disposition for x in r.collect()] == ["indel"] and not v.count()
    ten = snps(spark, [("c1", i, "A", "C") for i in range(1, 11)])
    r, _ = split.split_single(reads(spark, ("r", "c1", 1, "30M", "A" * 30)), ten)
    assert [x.disposition for x in r.collect()] == ["excess_snps"]
    r, v = split.split_single(reads(spark, ("r", "c1", 1, "30M", "A" * 30)), ten, max_snps=10, max_seqs=10)
    assert [x.disposition for x in r.collect()] == ["excess_versions"] and not v.count()
    r, v = split.split_single(reads(spark, ("r", "c1", 1, "30M", "A" * 30)), ten, max_snps=10, max_seqs=1024)
    assert v.count() == 1023


@pytest.mark.parametrize("phased, expected", [([True, True], 2), ([False, False], 3), ([True, False], 3)])
def test_haplotypes(spark, phased, expected):
    sites = snps(spark, [("c1", 1, "A", "C"), ("c1", 4, "A", "G")])
    haps = [("c1", p, s, h1, h2, ph) for s, rows in {"s1": [(1, 1), (1, 0)], "s2": [(0, 1), (0, 1)]}.items() for p, (h1, h2), ph in zip((1, 4), rows, phased, strict=True)]
    g = spark.createDataFrame(haps, "chrom string, pos long, sample string, hap1 int, hap2 int, phased boolean")
    _, v = split.split_single(reads(spark, ("r", "c1", 1, "30M", "A" * 30)), sites, g)
    plain = set()
    for s in ("s1", "s2"):
        own = [x for x in haps if x[2] == s]
        combos = [[]]
        for x in own:
            choice = [(x[3], x[4])] if x[5] or x[3] == x[4] else [(x[3], x[4]), (x[4], x[3])]
            combos = [[*c, y] for c in combos for y in choice]
        for c in combos:
            for side in (0, 1):
                t = list("A" * 30)
                for pick, (p, alt) in zip(c, ((0, "C"), (3, "G")), strict=True):
                    t[p] = alt if pick[side] else "A"
                plain.add("".join(t))
    plain.discard("A" * 30)
    assert {x.seq for x in v.collect()} == plain and abs(len(plain) - expected) <= 1


PAIR = "qname long, mate long, flag int, chrom string, mate_chrom string, pos long, mate_pos long, cigar string, seq string"


def test_discordant_pair_is_left_out(spark):
    p = spark.createDataFrame([(1, 0, 67, "c1", "c1", 1, 11, "30M", "A" * 30), (1, 1, 131, "c1", "c1", 11, 1, "30M", "C" * 30), (2, 0, 67, "c1", "c1", 1, 11, "30M", "A" * 30), (2, 1, 131, "c1", "c1", 11, 1, "30M", "A" * 30)], PAIR)
    r, v = split.split_pairs(p, snps(spark, [("c1", 18, "A", "C"), ("c1", 35, "A", "G")]))
    assert {x.qname: x.disposition for x in r.collect()} == {1: "discordant", 2: "remap"}
    got = {(x.seq_a, x.seq_b) for x in v.collect()}
    a, b = "A" * 17 + "C" + "A" * 12, "A" * 7 + "C" + "A" * 22
    g = lambda s: s[:24] + "G" + s[25:]
    plain = "A" * 30
    assert got == {(a, b), (a, g(b)), (plain, g(plain))}


def test_names_go_both_ways(spark):
    df = spark.createDataFrame([("a.b.c", 5, 9)], "q string, p long, m long")
    name = alleles.encode_name(F.col("q"), [F.col("p"), F.col("m")], F.lit(2), F.lit(3))
    r = df.select(name.alias("n"), alleles.decode_name(name).alias("d")).first()
    assert r.n == "a.b.c.5-9.2.3" and tuple(r.d) == ("a.b.c", 5, 9, 2, 3)


def test_remap_verdicts(spark):
    own = spark.createDataFrame([(q, "c1", 10, "30M") for q in ("keep", "moved", "gone", "half", "second", "changed")], "qname string, chrom string, pos long, cigar string")
    back = [("keep.10.1.2", 0, 10, "30M"), ("keep.10.2.2", 16, 10, "30M"), ("moved.10.1.1", 0, 11, "30M"), ("half.10.1.2", 0, 10, "30M"), ("second.10.1.1", 0, 10, "30M"), ("second.10.1.1", 256, 50, "30M"), ("changed.10.1.1", 0, 10, "10M1D20M")]
    b = spark.createDataFrame([(n, f, "c1", p, None, c) for n, f, p, c in back], "name string, flag int, chrom string, pos long, mate_pos long, cigar string")
    got = {r.qname: r.verdict for r in remap.remap_verdict(own, b).collect()}
    assert got == {"keep": "keep", "moved": "wrong_place", "gone": "missing", "half": "incomplete", "second": "poisoned", "changed": "cigar_changed"}


def test_duplicates(spark):
    r = spark.createDataFrame([(f"r{i}", f, "c1", p) for i, (f, p) in enumerate([(0, 5), (0, 5), (16, 5), (0, 9), (4, 9)])], "qname string, flag int, chrom string, pos long")
    got = remap.dedup_single(r).collect()
    assert sorted((x.pos, x.flag) for x in got) == [(5, 0), (5, 16), (9, 0)]
    assert remap.dedup_single(r.repartition(7)).orderBy("qname").collect() == sorted(got, key=lambda x: x.qname)
    p = spark.createDataFrame([(n, m, 67 if m == 0 else 131, "c1", "c1", a, b, "30M", "A" * 30) for n in (1, 2, 3) for m, (a, b) in enumerate(((1, 40), (40, 1)))] + [(4, 0, 67, "c1", "c1", 2, 40, "30M", "A" * 30)], PAIR)
    assert len({x.qname for x in remap.dedup_pairs(p).collect()}) == 1 and remap.dedup_pairs(p).count() == 2


def test_intervals_meet_once(spark):
    rnd = random.Random(5)
    make = lambda: [("c1", s := rnd.randint(1, 5000), s + rnd.randint(0, 3000)) for _ in range(60)]
    a, b = make(), make()
    df = lambda x: spark.createDataFrame(x, "chrom string, start long, stop long")
    got = overlap.interval_intervals(df(a), df(b)).count()
    assert got == sum(x[1] <= y[2] and y[1] <= x[2] for x in a for y in b)


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTNacgtnRY",)], "s string")
    r = df.select(seq.reverse_complement(F.col("s")).alias("r"), seq.gc_fraction(F.col("s")).alias("g"), seq.wrap(F.col("s"), 5).alias("w")).first()
    assert (r.r, r.g, r.w) == ("RYnacgtNACGT", 0.5, "ACGTN\nacgtn\nRY")


def test_coordinates(spark):
    df = spark.range(1).select(coords.expanded(F.lit(5), F.lit(10), 7, F.lit(12)).alias("e"), coords.overlaps((F.lit(1), F.lit(5)), (F.lit(5), F.lit(9))).alias("o"), coords.overlaps((F.lit(1), F.lit(5)), (F.lit(5), F.lit(9)), (F.lit(1), F.lit(-1))).alias("s"))
    r = df.first()
    assert tuple(r.e) == (1, 12) and r.o and not r.s


def test_names_of_chromosomes():
    assert chroms.parse_names("1-3 chrX") == ["chr1", "chr2", "chr3", "chrX"]
    with pytest.raises(ValueError):
        chroms.parse_names("3-1")


def test_samples_must_be_there(spark):
    g = spark.createDataFrame([("c1", 1, "a", 0, 1)], "chrom string, pos long, sample string, hap1 int, hap2 int")
    assert counts.subset_samples(g, ["a", "a"]).count() == 1
    with pytest.raises(ValueError, match="not found"):
        counts.subset_samples(g, ["b"])


def test_pairs_must_come_back_as_proper_pairs(spark):
    to_remap = spark.createDataFrame([(q, "c1", p, "5M") for q in ("ok", "improper", "single", "swapped", "moved", "second", "tied") for p in (10, 30)], "qname string, chrom string, pos long, cigar string")
    rows = []
    for q, flags, places, named in (("ok", (99, 147), (10, 30), (10, 30)), ("improper", (97, 145), (10, 30), (10, 30)), ("single", (0, 0), (10, 30), (10, 30)), ("swapped", (99, 147), (10, 30), (30, 10)), ("moved", (99, 147), (10, 31), (10, 30)), ("second", (99, 147 | 256), (10, 30), (10, 30)), ("tied", (163, 83), (10, 10), (10, 10))):
        rows += [(f"{q}.{named[0]}-{named[1]}.1.1", flags[i], "c1", places[i], places[1 - i], "5M") for i in (0, 1)]
    back = spark.createDataFrame(rows, "name string, flag int, chrom string, pos long, mate_pos long, cigar string")
    got = {r.qname: r.verdict for r in remap.remap_verdict(to_remap, back).collect()}
    assert got == {"ok": "keep", "improper": "poisoned", "single": "poisoned", "swapped": "wrong_place", "moved": "wrong_place", "second": "poisoned", "tied": "keep"}


def test_reads_of_other_individuals_are_no_duplicates(spark):
    reads = spark.createDataFrame([("a", 1, 0, "c", 5), ("b", 2, 0, "c", 5), ("c", 2, 0, "c", 5)], "qname string, individual long, flag int, chrom string, pos long")
    assert remap.dedup_single(reads).count() == 1 and remap.dedup_single(reads, by=("individual",)).count() == 2


def test_counting_leaves_out_clipped_and_past_the_end(spark):
    reads = spark.createDataFrame([("a", 1, "c", 5, "4M", "ACGT"), ("b", 1, "c", 98, "4M", "ACGT"), ("s", 1, "c", 5, "1S3M", "ACGT"), ("e", 1, "c", 5, "4=", "ACGT"), ("i", 1, "c", 20, "4M", "ACGT")], "qname string, individual long, chrom string, pos long, cigar string, seq string")
    snps = spark.createDataFrame([("c", 6, 0, "C", "T"), ("c", 7, 1, "G", "T"), ("c", 21, 2, "C", "CA")], "chrom string, pos long, snp_idx long, allele1 string, allele2 string")
    chroms = spark.createDataFrame([("c", 100)], "chrom string, length long")
    het = spark.createDataFrame([("c", 6, 1, 0, 0), ("c", 7, 1, 0, 1)], "chrom string, pos long, individual long, hap1 long, hap2 long")
    depth, alleles = counts.count_reads(reads, snps, chroms, het)
    assert [(r.pos, r.n) for r in depth.collect()] == [(5, 2)]
    assert [(r.site, r.ref_n, r.alt_n, r.other_n) for r in alleles.collect()] == [(7, 1, 0, 0)]


def test_verdicts_tell_individuals_apart(spark):
    """Two individuals have a read of the same name; the version of one came back elsewhere."""
    to_remap = spark.createDataFrame([("a", "r", "c1", 5, "4M"), ("b", "r", "c1", 5, "4M"), ("c", "r", "c1", 5, "4M")], "individual string, qname string, chrom string, pos long, cigar string")
    name = alleles.encode_name(F.col("qname"), [F.col("pos")], F.lit(1), F.lit(1))
    back = to_remap.where("individual <> 'c'").select("individual", name.alias("name"), F.lit(0).alias("flag"), "chrom", F.when(F.col("individual") == "b", 9).otherwise(5).cast("long").alias("pos"), F.lit(0).cast("long").alias("mate_pos"), "cigar")
    got = {r.individual: r.verdict for r in remap.remap_verdict(to_remap, back, by=("individual",)).collect()}
    assert got == {"a": "keep", "b": "wrong_place", "c": "missing"}
