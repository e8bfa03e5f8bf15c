"""Reads meet variants a bin at a time, and carry on no more than they need."""

from pyspark.sql import functions as F

from lodestrand.operators import counts, overlap, split


def reads(spark, *rows):
    return spark.createDataFrame(list(rows), "qname string, chrom string, pos long, cigar string, seq string, flag int")


def snps(spark, rows):
    return spark.createDataFrame([(c, i, p, a, b) for i, (c, p, a, b) in enumerate(rows)], "chrom string, snp_idx long, pos long, allele1 string, allele2 string")


def test_sites_of_too_many_or_over_an_indel_are_counted_and_not_listed(spark):
    r = reads(spark, ("few", "c1", 100, "40M", "A" * 40, 0), ("many", "c2", 100, "40M", "A" * 40, 0), ("indel", "c3", 100, "40M", "A" * 40, 0))
    v = snps(spark, [("c1", 127, "A", "C"), ("c1", 128, "A", "C"), *(("c2", p, "A", "C") for p in (100, 101, 127, 128)), ("c3", 101, "A", "C"), ("c3", 139, "A", "CC")])
    got = {x.qname: x for x in split.sites_of(r, v, most=2).collect()}
    assert [s.read_pos for s in got["few"].sites] == [28, 29] and got["few"].n_snps == 2
    assert got["many"].n_snps == 4 and got["indel"].n_indels == 1
    assert sum(len(x.sites) for x in got.values()) == 2 + 1 + 1  # none of a bin that holds too many or an indel


def test_hits_are_made_from_a_row_a_bin(spark):
    r = reads(spark, ("r", "c1", 120, "5M2D20M", "A" * 25, 0))
    v = snps(spark, [("c1", p, "A", "C") for p in range(100, 160)] + [("c1", 126, "A", "")])
    got = overlap.read_variants(r, v).orderBy("site").collect()
    assert [x.site for x in got] == [*range(120, 125), 126, *range(127, 147)]
    assert [x.read_pos for x in got] == [*range(1, 6), 6, *range(6, 26)]
    assert overlap.variant_bins(v).count() == 2


def test_pairs_are_split_with_one_join(spark, sf_dir):
    from lodestrand.plans import views

    _, versions = split.split_pairs(views.pairs(spark, sf_dir).limit(100), views.snps(spark, sf_dir))
    plan = versions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Window") == 0


def test_shared_sites_of_two_cigars(spark):
    a = F.struct(F.lit(10).cast("long").alias("pos"), F.lit("10M5N10M").alias("cigar"), F.lit("A" * 20).alias("seq"))
    b = F.struct(F.lit(18).cast("long").alias("pos"), F.lit("3S12M").alias("cigar"), F.lit("TTTAACCAAAAAAAA").alias("seq"))
    pairs = spark.range(1).select(F.lit("q").alias("qname"), F.lit("c1").alias("chrom"), a.alias("a"), b.alias("b"))
    got = split.shared_sites(pairs, snps(spark, [("c1", p, "A", "C") for p in (12, 18, 19, 22, 25, 29)])).first()
    assert (got.n_shared, got.discordant) == (4, False)
    assert split.shared_sites(pairs.withColumn("a", F.col("a").withField("seq", F.lit("C" * 20))), snps(spark, [("c1", 25, "A", "C")])).first().discordant


def test_reads_are_counted_once_for_a_report(spark):
    n = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    schema = "individual long, chrom string, site long, ref string, alt string, ref_n long, alt_n long, other_n long"
    made = spark.createDataFrame([(i, "c1", 10 + i, "A", "C", i, 1, 0) for i in range(3)], schema).mapInArrow(seen, schema)
    genotypes = spark.createDataFrame([(7, "c1", 10, 0, 1), (0, "c1", 10, None, 1)], "individual long, chrom string, pos long, hap1 long, hap2 long")
    got = counts.dense_report(snps(spark, [("c1", 10, "A", "C"), ("c1", 12, "A", "C")]), made, genotypes, by=("individual",)).collect()
    assert {(r.individual, r.pos): (r.ref_n, r.alt_n, r.genotype) for r in got} == {(i, p): (i if hit else 0, int(hit), "0|1" if (i, p) == (7, 10) else "NA") for i in (0, 1, 2, 7) for p in (10, 12) for hit in [i < 3 and p == 10 + i]}
    assert len(got) == 8 and n.value == 3
