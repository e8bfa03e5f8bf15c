"""Likelihoods, minimisers, fits and streams."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from lodestrand.functions import likelihood
from lodestrand.operators import association, haplotypes, optimize, simulate
from lodestrand.plans import queries
from lodestrand.streaming import mates


def test_lgamma_and_lbeta(spark):
    values = [10**k * m for k in range(-3, 6) for m in (1.0, 2.7, 6.1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", likelihood.lgamma(F.col("x")).alias("y"), likelihood.lbeta(F.col("x"), F.lit(3.5)).alias("b"), likelihood.lbeta(F.col("x") * 1e8, F.lit(3.5)).alias("far")).collect():
        assert abs(r.y - math.lgamma(r.x)) < 1e-9 * max(1, abs(r.y))
        assert abs(r.b - association.lbeta(r.x, 3.5)) < 1e-8
        assert abs(r.far - association.lbeta(r.x * 1e8, 3.5)) < 1e-6


def test_likelihoods_match_the_plain_ones_and_sum_to_one(spark):
    df = spark.range(0, 40).select(F.col("id").cast("double").alias("k"))
    got = df.select("k", likelihood.beta_negative_binomial(F.col("k"), F.lit(20.0), F.lit(0.1), F.lit(50.0)).alias("n"), likelihood.beta_binomial(0.4, F.lit(0.3), F.col("k"), 40 - F.col("k"), F.lit(0.8)).alias("b")).collect()
    for r in got:
        assert abs(r.n - association.bnb_loglik(int(r.k), 20.0, 0.1, 50.0)) < 1e-7
        assert abs(r.b - association.bb_loglik(0.4, 0.3, int(r.k), 40 - int(r.k), 0.8)) < 1e-7
    assert abs(sum(math.exp(association.bnb_loglik(k, 5.0, 0.3, 10.0)) for k in range(3000)) - 1) < 1e-3


def test_minimisers():
    x, v = optimize.simplex(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2, [0.0, 0.5])
    assert np.allclose(x, [3, -1], atol=1e-2) and v < 1e-3
    assert abs(optimize.bounded(lambda t: (t - 0.3) ** 4 + t, 0, 1)[0]) < 0.01
    assert abs(optimize.bounded(math.cos, 2, 5)[0] - math.pi) < 1e-4


def test_effects_are_found_and_null_regions_are_not(spark):
    null = association.combined_test(simulate.simulate_counts(spark, n_tests=30, n_inds=12, seed=3))
    assert sum(r.p_value < 0.05 for r in null.collect()) <= 6
    found = association.combined_test(simulate.simulate_counts(spark, n_tests=12, n_inds=12, effect=2.5, effect_share=1.0, allele_freq=0.4, seed=4))
    assert sum(r.p_value < 0.05 for r in found.collect()) >= 9


def test_simulation_does_not_depend_on_partitions(spark):
    a = simulate.simulate_counts(spark, n_tests=8).orderBy("region_id", "individual").collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    assert simulate.simulate_counts(spark, n_tests=8).orderBy("region_id", "individual").collect() == a
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_allele_dispersion_matches_a_plain_search(spark):
    rows = simulate.simulate_counts(spark, n_tests=30, n_inds=2, allele_freq=0.5)
    got = {r.individual: r for r in association.fit_allele_dispersion(rows).collect()}
    for name, group in rows.toPandas().groupby("individual"):
        sites = [(s.ref_n, s.alt_n) for snps in group.region_snps for s in snps if s.het_prob > 0.9 and s.ref_n + s.alt_n]
        best, value = optimize.bounded(lambda d, s=sites: -sum(association.bb_loglik(0.5, d, a, b, 0.99) for a, b in s), 0.01, 0.99)
        assert abs(got[name].loglik + value) < 1e-2, best


def test_allele_dispersion_takes_uncertain_sites(spark, sf_dir, monkeypatch):
    rows = simulate.simulate_counts(spark, n_tests=30, n_inds=2, allele_freq=0.5, het_error=0.2)
    monkeypatch.setattr(queries, "_simulated", lambda *_: rows)
    monkeypatch.setattr(queries, "input_rows", lambda *_: rows)
    got = {r.individual: r for r in queries.QUERIES["fit_as"](spark, sf_dir).collect()}
    groups = rows.toPandas().groupby("individual")
    assert set(got) == set(groups.groups)
    for name, group in groups:
        sites = [(s.ref_n, s.alt_n, s.het_prob) for snps in group.region_snps for s in snps]
        best, value = optimize.bounded(lambda d, s=sites: -sum(association.bb_loglik(0.5, d, *x) for x in s), 0.01, 0.99)
        assert abs(got[name].loglik + value) < 1e-2, best


def test_queries_fit_with_the_defaults(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(association, "fit_depth_dispersion", lambda rows, **k: given.append(k))
    monkeypatch.setattr(association, "fit_depth_model", lambda rows, **k: given.append(k) or rows.select("individual"))
    monkeypatch.setattr(association, "apply_depth_model", lambda rows, coefs: rows.withColumn("expected", F.lit(1.0)))
    queries.QUERIES["fit_bnb"](spark, sf_dir)
    queries.QUERIES["depth_splines"](spark, sf_dir)
    assert given == [{}, {}]


def test_heavy_queries_read_the_tables(spark, sf_dir, monkeypatch):
    rows, seen = queries.input_rows(spark, sf_dir), []
    monkeypatch.setattr(queries, "input_rows", lambda *a: seen.append(a[1]) or rows)
    for name in ("fit_allele_dispersion", "fit_depth_dispersion", "combined_test", "loadings"):
        monkeypatch.setattr(association, name, lambda given, *_, **__: given)
    assert all(queries.QUERIES[n](spark, sf_dir) is rows for n in ("fit_as", "fit_bnb", "cht_test", "pca_loadings")) and len(seen) == 4
    assert queries.QUERIES["simulate_counts"](spark, sf_dir).select("region_id").distinct().count() == 10_000


def test_permutation_keeps_genotypes(spark):
    rows = simulate.simulate_counts(spark, n_tests=3)
    moved = haplotypes.permuted(rows)
    count = lambda d: sorted(map(tuple, d.groupBy("region_id", "genotype").count().collect()))
    assert count(moved) == count(rows) and moved.exceptAll(rows.select(*moved.columns)).count() > 0


def test_loadings_are_those_of_the_matrix(spark):
    rows = simulate.simulate_counts(spark, n_tests=40, n_inds=4)
    got = association.loadings(rows, "region_reads").toPandas().pivot(index="individual", columns="component", values="loading").to_numpy()
    m = rows.toPandas().pivot(index="region_id", columns="individual", values="region_reads").to_numpy(float)
    _, _, v = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(v.T), atol=1e-6)


def test_het_probabilities_move_with_counts(spark):
    rows = spark.createDataFrame([("t", "c1", "a", [(5, 0.9), (9, 0.9)])], "region_id string, chrom string, individual string, region_snps array<struct<pos:bigint,het_prob:double>>")
    n = spark.createDataFrame([("c1", 5, "a", 20, 20), ("c1", 9, "a", 40, 0)], "chrom string, site long, individual string, ref_n long, alt_n long")
    got = [s.het_prob for s in haplotypes.update_het_probs(rows, n).first().region_snps]
    assert got[0] > 0.999 and got[1] < 0.01


def test_mates_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("c1", "a", 5), ("c1", "a", 20), ("c1", "b", 7)], "chrom string, qname string, pos long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chrom string, qname string, pos long").parquet(str(tmp_path / "in"))
    q = mates.pair_stream(stream).writeStream.format("memory").queryName("mates").option("checkpointLocation", str(tmp_path / "ck")).start()
    pairs = "SELECT * FROM mates WHERE state = 'paired'"
    for _ in range(60):  # a stream with timeouts never says that it is done
        if spark.sql(pairs).count():
            break
        time.sleep(0.5)
    q.stop()
    assert [tuple(r) for r in spark.sql(pairs).collect()] == [("c1", "a", 5, 20, "paired")]


def test_many_functions_are_minimised_as_one(spark):
    goal = np.array([[3.0, -1.0], [0.5, 2.0], [-4.0, 0.25]])

    def cost(which, x):
        return ((x - goal[which]) ** 2 * [1, 10]).sum(axis=1)

    x, value = optimize.simplex_many(cost, np.array([[0.0, 0.5]] * 3))
    for i in range(3):
        one, least = optimize.simplex(lambda p, i=i: float(cost(np.array([i]), p[None])[0]), [0.0, 0.5])
        assert np.allclose(x[i], one, atol=1e-12) and abs(value[i] - least) < 1e-12


def test_regions_fitted_together_equal_plain_likelihoods(spark):
    g = np.random.default_rng(3)
    rows = []
    for r in range(6):
        for i in range(12):
            dose = int(g.integers(0, 3))
            sites = [(100 + r, 0.95, 1.0, int(g.integers(0, 9)), int(g.integers(0, 9)), 0) for _ in range(int(g.integers(0, 3)))]
            rows.append((f"r{r}", "c", r, f"i{i:02d}", float(dose), sites, int(g.integers(0, 40)), float(1000 + i)))
    df = spark.createDataFrame(rows, "region_id string, chrom string, test_pos long, individual string, genotype double, region_snps array<struct<pos:bigint,het_prob:double,linkage:double,ref_n:bigint,alt_n:bigint,other_n:bigint>>, region_reads long, genome_reads double")
    got = {r.region_id: r for r in association.combined_test(df).collect()}
    for k, r in got.items():
        own = [x for x in rows if x[0] == k]
        total = 0.0
        for x in own:
            mean = {0: 2 * r.alpha, 1: r.alpha + r.beta, 2: 2 * r.beta}[int(x[4])] * x[7] / 1000
            total += float(association.bnb_loglik(np.array(float(x[6])), np.array(mean), np.array(r.dispersion), np.array(1000.0)))
            if x[4] == 1:
                total += sum(float(association.bb_loglik(r.alpha / (r.alpha + r.beta), 0.001, s[3], s[4], s[1])) for s in x[5])
        assert abs(total - r.loglik_alt) < 1e-6 * abs(total) + 1e-6 and r.loglik_alt >= r.loglik_null - 1e-3
        assert r.all_reads == sum(x[6] for x in own) and r.as_ref == sum(s[3] for x in own if x[4] == 1 for s in x[5])


def test_dispersions_are_found_again(spark):
    rows = simulate.simulate_counts(spark, n_tests=400, n_inds=6, depth_disp=60.0, gene_disp=0.05, mean=150.0)
    got = association.fit_depth_dispersion(rows, sample=None).collect()
    own = sorted((r.region_id, r.individual, r.region_reads) for r in rows.collect())
    k, at = np.array([float(r[2]) for r in own]), np.repeat(np.arange(400), 6)

    def loglik(disp, gene):
        d = np.tile(disp, 400)
        mean = association._best_mean(k, np.ones(len(k)), d, gene, d, at, 400)[at]
        return association.bnb_loglik(k, mean, np.array(gene), d).sum()

    found, gene = np.array([r.disp for r in sorted(got, key=lambda r: r.individual)]), got[0].region_disp
    best = loglik(found, gene)
    assert len(got) == 6 and best >= loglik(np.full(6, 60.0), 0.05)
    assert all(best >= loglik(found * np.where(np.arange(6) == i, f, 1), gene) - 0.05 for i in range(6) for f in (0.8, 1.25)) and best >= max(loglik(found, gene * 0.9), loglik(found, gene * 1.1)) - 0.05
    each = association.fit_region_dispersion(rows, spark.createDataFrame([(r.individual, r.disp) for r in got], "individual string, disp double"))
    mean = each.agg(F.avg("mean"), F.count("*")).first()
    assert mean[1] == 400 and 120 < mean[0] < 180
    few = association.fit_depth_dispersion(rows, sample=50, max_rounds=3)
    assert few.count() == 6


def test_ranks_in_stretches(spark):
    g = np.random.default_rng(2)
    p = np.where(g.random(3000) < 0.4, 1.0, g.random(3000))
    p[:3] = 0
    df = spark.createDataFrame([(f"r{i:05d}", float(x)) for i, x in enumerate(p)], "region_id string, p_value double")
    for f, c in ((association.false_discovery, "fdr"), (association.expected_ranks, "expected")):
        whole = {r.region_id: r[c] for r in f(df).collect()}
        cut = {r.region_id: r[c] for r in f(df, stretch=200).collect()}
        assert whole.keys() == cut.keys() and all(abs(whole[k] - cut[k]) < 1e-12 for k in whole)
    sizes = association.ranked(df, "p_value", stretch=200)[0].groupBy("_s").count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 600
    assert association.false_discovery(df.where("1 = 0")).count() == 0


def test_loadings_equal_those_of_the_matrix(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(200, 5)) @ g.normal(size=(5, 5))
    df = spark.createDataFrame([(f"r{i}", j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "region_id string, individual int, reads double")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for r in association.loadings(df, "reads").collect():
        assert abs(abs(vectors[r.individual, 5 - r.component]) - abs(r.loading)) < 1e-8


def test_simulated_fragments_cover_heterozygous_sites(spark):
    bases = "".join("ACGT"[i * i % 7 % 4] for i in range(400))
    chunks = spark.createDataFrame([("chr1", 1, bases[:200]), ("chr1", 201, bases[200:])], "chrom string, chunk_start long, bases string")
    sites = [(3, 1, 0), (100, 0, 1), (150, 1, 1), (199, 0, 1)]
    haps = spark.createDataFrame([("chr1", p, bases[p - 1], "N", a, b) for p, a, b in sites], "chrom string, pos long, ref string, alt string, hap1 int, hap2 int")
    copies = simulate.haplotype_chunks(chunks, haps, chunk=200)
    own = {(r.chunk_start, r.hap): r for r in copies.collect()}
    assert own[1, 1].sites == own[1, 2].sites == [3, 100, 199] and own[201, 1].sites == []
    got = simulate.simulate_reads(copies, 50).collect()
    assert len(got) == 100 and {r.hap for r in got} == {1, 2}
    covered = set()
    for r in got:
        over = {p for p in (3, 100, 199) if r.pos_a <= p < r.pos_a + 36 or r.pos_b <= p < r.pos_b + 36}
        assert over and 1 <= r.pos_a <= r.pos_b and r.pos_b + 36 <= 201
        covered |= over
        at = own[1, r.hap].bases
        assert r.seq_a == at[r.pos_a - 1 : r.pos_a + 35]
        assert r.seq_b == at[r.pos_b - 1 : r.pos_b + 35].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert covered == {3, 100, 199}
    free = simulate.simulate_reads(copies.drop("sites"), 5).collect()
    assert len(free) == 20 and free == simulate.simulate_reads(copies.drop("sites"), 5).collect()
    # a place that neither end of a fragment as long as the sequence can cover
    assert simulate._start(np.random.default_rng(1), 50, 101, 20, 101)[1] == 20


# -- ranks over many stretches, depth models of all rows


def test_ranks_when_stretches_grow(spark, monkeypatch):
    """Beyond the most stretches, each gets longer; none ever holds everything."""
    monkeypatch.setattr(association, "MOST_STRETCHES", 5)
    g = np.random.default_rng(1)
    p = np.where(g.random(4_000) < 0.4, 0.5, g.random(4_000))  # many share a p
    df = spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(p)], "region_id long, p_value double").repartition(3)
    got, n = association.ranked(df, "p_value", stretch=100)
    rows = got.collect()
    assert n == 4_000 and [r.region_id for r in sorted(rows, key=lambda r: r._rank)] == sorted(range(4_000), key=lambda i: (p[i], i))
    sizes = [sum(r._s == s for r in rows) for s in {r._s for r in rows}]
    assert len(sizes) == 5 and max(sizes) < 2_000
    m = sorted(p)
    want, low = {}, 1.0
    for k in range(n, 0, -1):
        low = want[m[k - 1]] = min(low, m[k - 1] * n / k)
    fdr = {r.region_id: r.fdr for r in association.false_discovery(df, stretch=100).collect()}
    assert all(abs(fdr[i] - want[p[i]]) < 1e-12 for i in range(n))


def test_depth_models_are_no_worse_than_a_simplex(spark):
    g = np.random.default_rng(2)
    n = 3_000
    gc, total = g.uniform(0.2, 0.8, n), g.integers(5, 400, n).astype(float)
    rows, kept = [], {}
    for name, c in {"a": (0.1, 0.8, -0.5), "b": (-0.3, 0.0, 0.4), "c": (0.0, 0.0, 0.0)}.items():
        k = g.poisson(np.exp(c[0] + c[1] * gc + c[2] * gc**2) * total / 4)
        kept[name] = k
        rows += [(i, name, float(gc[i]), int(k[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "region_id long, individual string, gc double, reads long")
    all_reads = sum(kept.values()).astype(float)
    powers, depths = np.stack([gc**i for i in range(5)], axis=1), np.stack([all_reads**i for i in range(1, 5)], axis=1)

    def loss(c, k):
        e = np.maximum(np.exp(powers @ c[:5]) * (depths @ c[6:]), 1e-6)
        return float((e - k * np.log(e)).sum())

    for r in association.fit_depth_model(df).collect():
        c, k = np.array(r.coefs), kept[r.individual]
        start = np.zeros(10)
        start[6] = k.sum() / all_reads.sum()
        x, _ = optimize.simplex(lambda y, k=k: loss(y, k), start.tolist(), max_iter=4_000)
        assert len(c) == 10 and r.converged and loss(c, k) <= loss(x, k) + 1e-6 * abs(loss(x, k))
        for i in (0, 1, 2, 6):  # and no neighbour is better
            for step in (-1e-3, 1e-3):
                near = c.copy()
                near[i] *= 1 + step
                assert loss(near, k) >= loss(c, k) - 1e-6 * abs(loss(c, k))
    assert association.fit_depth_model(df, sample=100).count() == 3 and association.fit_depth_model(df.where("1 = 0")).count() == 0


def test_depth_models_that_do_not_come_to_rest_say_so(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a", 0.3 + i % 5 / 10, 3 + i * i % 17) for i in range(50)], "region_id long, individual string, gc double, reads long")
    assert association.fit_depth_model(df).first().converged
    monkeypatch.setattr(association, "MOST_PASSES", 1)
    assert not association.fit_depth_model(df).first().converged


def test_depth_models_of_small_individuals_take_one_job(spark, monkeypatch):
    g, passes, sums = np.random.default_rng(5), [], association._depth_sums
    rows = [(i, name, float(round(x, 2)), int(k)) for name, n in (("a", 600), ("b", 60), (None, 60)) for i, (x, k) in enumerate(zip(g.uniform(0.3, 0.7, n), g.poisson(30, n), strict=True))]
    df = spark.createDataFrame(rows, "region_id long, individual string, gc double, reads long")
    monkeypatch.setattr(association, "_depth_sums", lambda table, asked, scale: passes.append(set(asked)) or sums(table, asked, scale))
    found = []
    for most, large in ((100_000, set()), (100, {"a"}), (0, {"a", "b", None})):  # rows of one GC and total that a task holds
        monkeypatch.setattr(association, "ONE_TASK", most, raising=False)
        passes.clear()
        found.append({r.individual: r for r in association.fit_depth_model(df).collect()})
        assert set().union(*passes) == large
    monkeypatch.setattr(association, "ONE_TASK", 100_000)
    turned = spark.createDataFrame(rows[::-1], df.schema).repartition(3)
    assert all(r.coefs == found[0][r.individual].coefs for r in association.fit_depth_model(turned).collect())  # to the last bit
    powers = np.array([[0.5**i for i in range(5)]])
    for name in ("a", "b", None):
        at = [float(np.exp(powers @ f[name].coefs[:5])[0] * sum(c * 60.0**i for i, c in enumerate(f[name].coefs[5:]))) for f in found]
        assert all(f[name].converged for f in found) and np.allclose(at, at[0], rtol=1e-4)


def test_depth_splines_count_reads_once(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(association, "fit_depth_model", lambda rows: given.append(rows) or rows.select("individual"))
    monkeypatch.setattr(association, "apply_depth_model", lambda rows, coefs: given.append(rows) or rows.withColumn("expected", F.lit(1.0)))
    queries.QUERIES["depth_splines"](spark, sf_dir)
    assert len(given) == 2 and not [f for rows in given for f in rows.inputFiles() if "orders.parquet" in f]
    own, want = (d.select("region_id", "individual", F.col(c).alias("n")) for d, c in ((given[0], "reads"), (queries.input_rows(spark, sf_dir), "region_reads")))
    assert own.count() == want.count() > 0 and own.exceptAll(want).count() == 0
    assert given[0].groupBy("region_id").agg(F.sum("reads").alias("n"), F.min("region_total").alias("a"), F.max("region_total").alias("z")).where("n <> a OR n <> z").count() == 0


def test_region_depth_is_that_of_the_rows(spark):
    regions = spark.createDataFrame([("r", "c", 1000, [900, 950], [960, 1100]), ("s", "c", 5000, [4900], [5100])], "region_id string, chrom string, test_pos long, starts array<long>, stops array<long>")
    genotypes = spark.createDataFrame([("c", 1000, "a", 0, 1), ("c", 1000, "b", None, None), ("c", 955, "d", 0, 1), ("c", 5000, "a", 1, 1)], "chrom string, pos long, individual string, hap1 int, hap2 int")
    depth = spark.createDataFrame([("c", 955, "a", 2), ("c", 1001, "b", 4), ("c", 955, "d", 9), ("c", 5001, "b", 9)], "chrom string, pos long, individual string, n long")
    n = spark.createDataFrame([], "chrom string, site long, individual string, ref_n long, alt_n long, other_n long")
    own = sorted(map(tuple, haplotypes.region_depth(regions, genotypes, depth).collect()))
    genome = depth.groupBy("individual").agg(F.sum("n").alias("genome_n"))
    assert own == [("r", "a", 4), ("r", "b", 4), ("s", "a", 0)]  # an unknown allele is a genotype; no genotype at the test site is no row
    assert own == sorted(map(tuple, haplotypes.input_rows(regions, genotypes, n, depth, genome).select("region_id", "individual", "region_reads").collect()))


def test_leading_components_equal_exact_ones(spark):
    g = np.random.default_rng(7)
    n, m = 40, 300
    x = g.normal(size=(m, 4)) @ (np.array([9, 6, 4, 2])[:, None] * g.normal(size=(4, n))) + g.normal(size=(m, n)) + g.normal(size=n) * 20
    df = spark.createDataFrame([(i, f"n{j:02}", float(x[i, j])) for i in range(m) for j in range(n)], "region_id long, individual string, reads double")
    vectors = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :3]
    got = np.zeros((n, 3))
    for r in association.leading_loadings(df, components=3).collect():
        got[int(r.individual[1:]), r.component - 1] = r.loading
    assert np.abs(np.abs((got * vectors).sum(axis=0)) - 1).max() < 1e-6 and np.linalg.norm(vectors - got @ (got.T @ vectors)) < 1e-6
    exact = {(r.individual, r.component): r.loading for r in association.loadings(df, components=3).collect()}
    assert all(abs(exact[f"n{j:02}", k + 1] - got[j, k]) < 1e-6 for j in range(n) for k in range(3))
    assert association.leading_loadings(df.where("1 = 0")).count() == 0
    assert association.leading_loadings(df.where("individual < 'n02'"), components=5).count() == 4


def test_sites_of_regions_are_cut_once(spark):
    regions = spark.createDataFrame([("r", "c", 1000, [900, 950, 5000], [960, 1000, 5001])], "region_id string, chrom string, test_pos long, starts array<long>, stops array<long>")
    haps = [("c", p, "a", h, 1 - h) for p, h in ((899, 0), (950, 1), (1000, 0), (5001, 1))] + [("c", 960, "a", 0, 0), ("c", 955, "a", None, 1)]
    genotypes = spark.createDataFrame(haps, "chrom string, pos long, individual string, hap1 int, hap2 int")
    n = spark.createDataFrame([("c", 950, "a", 3, 2, 1), ("c", 5001, "a", 7, 0, 0)], "chrom string, site long, individual string, ref_n long, alt_n long, other_n long")
    depth = spark.createDataFrame([("c", 955, "a", 2), ("c", 5000, "a", 4), ("c", 4999, "a", 9)], "chrom string, pos long, individual string, n long")
    got = haplotypes.region_lists(regions, genotypes, n, depth).collect()
    assert [(r.individual, r.known, r.hap1, r.region_n) for r in got] == [("a", True, 0, 2 + 2 + 4)]  # a place in two parts counts in both
    assert [(s.pos, s.ref_n, s.alt_n, s.other_n) for s in got[0].region_snps] == [(950, 2, 3, 1), (1000, 0, 0, 0), (5001, 0, 7, 0)]


def test_sites_without_reads_are_not_fitted():
    one = np.ones(1)
    make = lambda ref, alt: association.Regions(np.array([1]), np.array([1]), 9 * one, one, 50 * one, np.array([len(ref)]), np.array(ref, float), np.array(alt, float), np.full(len(ref), 0.99), 0.1 * one)
    data = make([5, 0, 0], [3, 0, 0])
    at = (np.array([0]), one, 2 * one, 0.2 * one, np.zeros((1, 0)), "combined")
    assert data.sites.tolist() == [1]
    assert abs(data.loglik(*at)[0] - make([5], [3]).loglik(*at)[0] - 2 * np.log(1.01)) < 1e-9


def test_haplotype_versions_list_no_more_sites_than_they_use(spark, sf_dir, monkeypatch):
    from lodestrand.operators import split

    given, own = [], split.sites_of
    monkeypatch.setattr(split, "sites_of", lambda *a, **k: given.append(k.get("most")) or own(*a, **k))
    queries.QUERIES["versions_haplotype_unphased"](spark, sf_dir)
    assert given == [split.MAX_SNPS]
