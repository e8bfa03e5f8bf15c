"""The combined test of read depth and allelic imbalance, and the fits of its dispersions.

A region's rows are one per individual; they are brought together by a grouped
list, and a batch of regions is fitted at once in numpy.  Everything around it
is DataFrame work; dispersions are found on grids whose likelihoods Spark sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder
from .optimize import simplex_many

READ_ERROR = 0.005
FLAT = 1e7
RESULT = "region_id string, chrom string, test_pos long, loglik_null double, loglik_alt double, chi_square double, p_value double, alpha double, beta double, dispersion double, all_reads long, as_reads long, as_ref long, as_alt long, n_individuals int, error string"
#: Regions that are fitted at once.
AT_ONCE = 1_000
#: Points on either side of a grid's middle, and the finest step (of logarithms).
SIDE, FINEST = 16, 1e-3


def _stirling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln Gamma of x + 8 by Stirling's series, and the product that brings it back to x."""
    y = x + 8
    v = 1 / y
    q = x * (x + 7)
    product = q * (q + 6) * (q + 10) * (q + 12)  # x (x + 1) ... (x + 7)
    w = v * v
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + v * (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))), product


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers."""
    series, product = _stirling(x)
    return series - np.log(product)


def lbeta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln Beta, by its series where an argument is very large."""
    large, small = np.maximum(a, b), np.minimum(a, b)
    x, y = np.minimum(large, 1e6), np.minimum(small, 1e6)
    (sx, px), (sy, py), (sb, pb) = _stirling(x), _stirling(y), _stirling(x + y)
    out = np.array(sx + sy - sb + np.log(pb / (px * py)))
    far = large >= 1e6
    if far.any():
        l, s = np.broadcast_to(large, out.shape)[far], np.broadcast_to(small, out.shape)[far]
        q = s * (1 - s)
        out[far] = lgamma(s) - s * np.log(l) + q / (2 * l) + q * (1 - 2 * s) / (12 * l**2) - q * q / (12 * l**3)
    return out


def allele_error(ref: np.ndarray, alt: np.ndarray, error: float = READ_ERROR) -> np.ndarray:
    """Log-likelihood of allele counts at a site that is homozygous after all."""
    return np.logaddexp(math.log(error) * ref + math.log(1 - error) * alt, math.log(error) * alt + math.log(1 - error) * ref)


def bb_loglik(p: np.ndarray, sigma: np.ndarray, ref: np.ndarray, alt: np.ndarray, het: np.ndarray, wrong: np.ndarray | None = None) -> np.ndarray:
    """Beta-binomial log-likelihood of allele counts; wrong is that of error alone, if known."""
    wrong = allele_error(ref, alt) if wrong is None else wrong
    scale = 1 / sigma**2 - 1
    a, b = np.maximum(p * scale, 1e-10), np.maximum((1 - p) * scale, 1e-10)
    own = lbeta(ref + a, alt + b) - lbeta(a, b)
    with np.errstate(divide="ignore"):
        return np.where(het >= 1, own, np.where(het <= 0, wrong, np.logaddexp(np.log(het) + own, np.log1p(-np.minimum(het, 1)) + wrong)))


def ways(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of bnb_loglik() that neither mean nor sigma changes."""
    some = np.maximum(k, 1.0)
    return np.where(k > 0, -lbeta(n, some) - np.log(some), 0.0)


def bnb_loglik(k: np.ndarray, mean: np.ndarray, sigma: np.ndarray, n: np.ndarray, fixed: np.ndarray | None = None) -> np.ndarray:
    """Beta-negative-binomial log-likelihood of read counts; fixed is ways(k, n), if known."""
    mean = np.maximum(mean, 1e-5)
    p = np.asarray(n / (n + mean))
    sigma = np.broadcast_to(sigma, p.shape)
    scale = 1 / np.maximum(sigma, 1e-5) ** 2
    a, b = p * scale + 1, (1 - p) * scale
    out = (ways(k, n) if fixed is None else fixed) + lbeta(a + n, b + k) - lbeta(a, b)
    plain = sigma < 1e-5
    return np.where(plain, -lbeta(n, k + 1) - np.log(n + k) + n * np.log(p) + k * np.log1p(-p), out) if plain.any() else out


def _stretches(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] places, for all i in turn."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Regions:
    """Rows of some regions as arrays: those of a region lie together, and so do the sites of a row.

    rows: of each region.  dose, reads, scale, depth (the individual's
    dispersion): of each row.  sites: of each row.  ref, alt, het, spread (the
    individual's dispersion of alleles): of each site.  pcs: covariates of each row.
    """

    def __init__(self, rows: np.ndarray, dose: np.ndarray, reads: np.ndarray, scale: np.ndarray, depth: np.ndarray, sites: np.ndarray, ref: np.ndarray, alt: np.ndarray, het: np.ndarray, spread: np.ndarray, pcs: np.ndarray | None = None):
        self.rows, self.dose, self.reads, self.scale, self.depth, self.pcs = rows, dose, reads, scale, depth, pcs
        use = np.repeat(dose == 1, sites)  # alleles tell where the test site is heterozygous
        self.ref, self.alt, self.het, self.spread = ref[use], alt[use], np.minimum(het[use], 0.99), np.repeat(spread, sites)[use]
        own = np.repeat(np.repeat(np.arange(len(rows)), rows), np.where(dose == 1, sites, 0))
        # sites without reads add the same whatever the parameters are
        some = self.ref + self.alt > 0
        bare = np.full(int((~some).sum()), 0.5)
        self.bare = np.bincount(own[~some], bb_loglik(bare, bare, self.ref[~some], self.alt[~some], self.het[~some]), len(rows))
        self.ref, self.alt, self.het, self.spread, own = (x[some] for x in (self.ref, self.alt, self.het, self.spread, own))
        self.sites = np.bincount(own, minlength=len(rows))
        self.wrong = allele_error(self.ref, self.alt)
        self.ways = ways(reads, depth)

    def loglik(self, which: np.ndarray, alpha: np.ndarray, beta: np.ndarray, r: np.ndarray, coefs: np.ndarray, mode: str) -> np.ndarray:
        """Log-likelihood of regions: depth unless mode is as, alleles unless it is bnb."""
        out = np.zeros(len(which))
        local = np.arange(len(which))
        if mode != "as":
            n = self.rows[which]
            at, own = _stretches((np.cumsum(self.rows) - self.rows)[which], n), np.repeat(local, n)
            dose = self.dose[at]
            factor = 1.0 if self.pcs is None or not coefs.shape[1] else 1 + (self.pcs[at, : coefs.shape[1]] * coefs[own]).sum(axis=1)
            each = ((2 - dose) * alpha[own] + dose * beta[own]) * self.scale[at] * factor
            out += np.bincount(own, bnb_loglik(self.reads[at], np.maximum(each, 1e-6), r[own], self.depth[at], self.ways[at]), len(which))
        if mode != "bnb":
            out += self.bare[which]
            n = self.sites[which]
            at, own = _stretches((np.cumsum(self.sites) - self.sites)[which], n), np.repeat(local, n)
            if len(at):
                out += np.bincount(own, bb_loglik((alpha / (alpha + beta))[own], self.spread[at], self.ref[at], self.alt[at], self.het[at], self.wrong[at]), len(which))
        return out


def fit_regions(data: Regions, mode: str = "combined") -> dict[str, np.ndarray]:
    """Maximum likelihood of each region with one expression level for both alleles, then with two; their ratio's chi-square and p.

    Of two starts the one that ends better is gone on from.
    """
    n = len(data.rows)
    coefs = np.zeros((n, 0))

    def cost(which: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray, how: str) -> np.ndarray:
        bad = (a <= 0) | (b <= 0) | (r <= 0) | (r > 1)
        fine = lambda x: np.where(bad, 0.5, x)
        return np.where(bad, FLAT, -data.loglik(which, fine(a), fine(b), fine(r), c, how))

    first = "bnb" if mode != "as" else "as"
    x, value = np.zeros((n, 2)), np.full(n, np.inf)
    for s in ((0.5, 0.1), (0.5, 0.001)):
        found, at = simplex_many(lambda w, y: cost(w, y[:, 0], y[:, 0], y[:, 1], coefs[w], first), np.tile(s, (n, 1)))
        x, value = np.where((at < value)[:, None], found, x), np.minimum(at, value)
    for _ in range(0 if data.pcs is None else data.pcs.shape[1]):
        found, _ = simplex_many(lambda w, y: cost(w, x[w, 0], x[w, 0], x[w, 1], np.concatenate((coefs[w], y), axis=1), first), np.zeros((n, 1)))
        coefs = np.concatenate((coefs, found), axis=1)
    null, null_cost = simplex_many(lambda w, y: cost(w, y[:, 0], y[:, 0], y[:, 1], coefs[w], mode), x)
    alt, alt_cost = simplex_many(lambda w, y: cost(w, y[:, 0], y[:, 1], y[:, 2], coefs[w], mode), null[:, [0, 0, 1]])
    chi = 2 * (null_cost - alt_cost)
    return {"loglik_null": -null_cost, "loglik_alt": -alt_cost, "chi_square": chi, "p_value": np.array([math.erfc(math.sqrt(max(c, 0) / 2)) if c == c else math.nan for c in chi]), "alpha": alt[:, 0], "beta": alt[:, 1], "dispersion": alt[:, 2]}


def _gathered(rows: DataFrame, fields: Sequence[str | Column], keep: Sequence[str] = ()) -> DataFrame:
    """A row per region: region_id, keep, and rows: a list of one struct an individual, by individual.

    Fits are long and rows short, so the shuffle's partitions stay as many as they are set to be.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "region_id").groupBy("region_id").agg(*(F.first(c).alias(c) for c in keep), F.sort_array(F.collect_list(F.struct("individual", *fields))).alias("rows"))


def _individuals(table: DataFrame) -> list[str]:
    """Their names in order; what comes to the driver is a row for each."""
    return sorted(r[0] for r in table.select(F.explode("rows.individual").alias("i")).distinct().collect())


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many members the lists of a column have, and all members."""
    return np.diff(np.asarray(column.offsets)), column.flatten()


def _floats(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=float)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of AT_ONCE rows at most, with nothing before or after a slice."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.take(pa.array(np.arange(at, min(at + AT_ONCE, b.num_rows))))


def combined_test(rows: DataFrame, as_disp: DataFrame | None = None, bnb_disp: DataFrame | None = None, mode: str = "combined", pcs: DataFrame | None = None, min_as: int = 0, default_disp: float = 0.001) -> DataFrame:
    """A result per region that has reads at all.

    rows: region_id, chrom, test_pos, individual, genotype, region_snps,
    region_reads, genome_reads.  as_disp, bnb_disp: individual, disp (a default
    where there is none).  mode: combined, as or bnb.  pcs: individual, values.
    A region that cannot be fitted gives nulls and the reason.
    """
    if mode not in ("combined", "as", "bnb"):
        raise ValueError("mode must be combined, as or bnb")
    known = rows
    for table, name in ((as_disp, "as_disp"), (bnb_disp, "bnb_disp")):
        known = known.join(F.broadcast(table.select("individual", F.col("disp").cast("double").alias(name))), "individual", "left") if table is not None else known.withColumn(name, F.lit(None).cast("double"))
    known = known.join(F.broadcast(pcs.select("individual", F.col("values").alias("pcs"))), "individual", "left") if pcs is not None else known.withColumn("pcs", F.array().cast("array<double>"))
    sites = F.transform(F.filter("region_snps", lambda s: s["het_prob"] > 0.9), lambda s: F.struct(*(s[c].cast("double").alias(c) for c in ("ref_n", "alt_n", "het_prob"))))
    none = F.array().cast("array<struct<ref_n:double,alt_n:double,het_prob:double>>")
    flat = known.select(F.col("region_id").cast("string").alias("region_id"), "chrom", F.col("test_pos").cast("long").alias("test_pos"), F.col("individual").cast("string").alias("individual"), F.round(F.col("genotype")).cast("int").alias("dose"), F.coalesce(F.when(F.round(F.col("genotype")) == 1, sites), none).alias("sites"), F.col("region_reads").cast("long").alias("reads"), F.col("genome_reads").cast("double").alias("genome"), F.coalesce("as_disp", F.lit(default_disp)).alias("as_disp"), F.coalesce("bnb_disp", F.lit(1 / default_disp)).alias("bnb_disp"), "pcs").where("genome IS NOT NULL")
    names = [c.split()[0] for c in RESULT.split(", ")]
    fitted = ("loglik_null", "loglik_alt", "chi_square", "p_value", "alpha", "beta", "dispersion")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            n, each = _lists(b.column("rows"))
            field = {c: each.field(i) for i, c in enumerate(x.name for x in each.type)}
            genome = _floats(field["genome"])
            starts = np.cumsum(n) - n
            least = np.repeat(np.minimum.reduceat(genome, starts), n)
            scale = np.where(least > 0, genome / np.where(least > 0, least, 1), genome)
            dose, reads = _floats(field["dose"]), _floats(field["reads"])
            here = np.flatnonzero(np.isfinite(dose) & np.isfinite(reads))
            sites, site = _lists(field["sites"])
            at = _stretches((np.cumsum(sites) - sites)[here], sites[here])
            ref, alt, het = (_floats(site.field(i))[at] for i in range(3))
            m = np.bincount(np.repeat(np.arange(b.num_rows), n)[here], minlength=b.num_rows)
            values = None
            if pcs is not None:
                wide, value = _lists(field["pcs"])
                values = _floats(value).reshape(len(wide), -1)[here]
            data = Regions(m, dose[here].astype(np.int64), reads[here], scale[here], _floats(field["bnb_disp"])[here], sites[here], ref, alt, het, _floats(field["as_disp"])[here], values)
            own = np.repeat(np.arange(b.num_rows), data.sites)
            total, as_ref, as_alt = np.bincount(np.repeat(np.arange(b.num_rows), m), data.reads, b.num_rows), np.bincount(own, data.ref, b.num_rows), np.bincount(own, data.alt, b.num_rows)
            with np.errstate(all="ignore"):
                got = fit_regions(data, mode)
            fine = np.all([np.isfinite(got[c]) for c in fitted], axis=0)
            long = lambda x: pa.array(x.astype(np.int64))
            out = {c: b.column(c) for c in ("region_id", "chrom", "test_pos")} | {c: pa.array(got[c], mask=~fine) for c in fitted}
            out |= {"all_reads": long(total), "as_reads": long(as_ref + as_alt), "as_ref": long(as_ref), "as_alt": long(as_alt), "n_individuals": pa.array(m.astype(np.int32)), "error": pa.array(np.where(fine, None, "the likelihood is not finite"), pa.string())}
            keep = (as_ref + as_alt >= min_as) & (total + as_ref + as_alt > 0)
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names).filter(pa.array(keep))

    return _gathered(flat, ["dose", "sites", "reads", "genome", "as_disp", "bnb_disp", "pcs"], ["chrom", "test_pos"]).mapInArrow(fit, RESULT)


def _summed(table: DataFrame, of: Sequence[str], make, schema: str) -> DataFrame:
    """Partial sums of columns value by the columns of, as make gives them for record batches, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            yield pa.RecordBatch.from_pydict(make(b))

    return table.mapInArrow(run, schema).groupBy(*of).agg(F.sum("value").alias("value"))


def fit_allele_dispersion(rows: DataFrame, error: float = READ_ERROR, points: int = 33, rounds: int = 4, sure: bool = True) -> DataFrame:
    """individual, disp and loglik: the dispersion from 0.01 to 0.99 at which the allele counts of each are most likely at p = 1/2.

    Every site takes part with its own probability of being heterozygous; if
    sure, sites over 0.9 alone, with 0.99 at most.
    The likelihood is summed by Spark on a grid that closes in round by round,
    so that no individual's counts are gathered, however many they are.
    """
    sites = rows.select("individual", F.explode("region_snps").alias("s")).where("s.het_prob IS NOT NULL AND s.ref_n + s.alt_n > 0")
    sites = sites.where("s.het_prob > 0.9").withColumn("s", F.col("s").withField("het_prob", F.least("s.het_prob", F.lit(0.99)))) if sure else sites
    key = F.col("individual").cast("string").alias("i")
    table = sites.groupBy(key, *(F.col(f"s.{c}").cast("double").alias(c) for c in ("ref_n", "alt_n", "het_prob"))).agg(F.count("*").cast("double").alias("times")).persist()
    best = {r.i: (0.01, 0.99, 0.01, 0.0) for r in table.select("i").distinct().collect()}  # a row per individual
    for _ in range(rounds):
        bounds = {k: v[:2] for k, v in best.items()}

        def make(b: pa.RecordBatch, bounds: dict = bounds) -> dict:
            names, which = np.unique(np.array(b.column("i").to_pylist(), dtype=object), return_inverse=True)
            ref, alt, het, times = (_floats(b.column(c)) for c in ("ref_n", "alt_n", "het_prob", "times"))
            low, high = np.array([bounds[x] for x in names]).T
            wrong = allele_error(ref, alt, error)
            ll = np.stack([np.bincount(which, times * bb_loglik(0.5, (low + (high - low) * p / (points - 1))[which], ref, alt, het, wrong), len(names)) for p in range(points)], axis=1)
            return {"i": np.repeat(names, points).tolist(), "p": np.tile(np.arange(points), len(names)), "value": ll.ravel()}

        for r in _summed(table, ["i", "p"], make, "i string, p long, value double").groupBy("i").agg(F.max_by(F.struct("p", "value"), F.struct("value", -F.col("p"))).alias("t")).collect():  # a row per individual
            low, high = bounds[r.i]
            step = (high - low) / (points - 1)
            disp = low + step * r.t.p
            best[r.i] = (max(disp - step, 0.01), min(disp + step, 0.99), disp, r.t.value)
    table.unpersist()
    kind = rows.schema["individual"].dataType
    out = rows.sparkSession.createDataFrame([(k, v[2], v[3]) for k, v in best.items()], "i string, disp double, loglik double")
    return out.select(F.col("i").cast(kind).alias("individual"), "disp", "loglik")


def _best_mean(k: np.ndarray, t: np.ndarray, n: np.ndarray, gene: float, disp: np.ndarray, own: np.ndarray, count: int, steps: int = 5) -> np.ndarray:
    """Of each region the mean that is likeliest: a grid of logarithms that closes in on the best point."""
    total, width = np.bincount(own, k, count), np.bincount(own, t, count)
    middle, step = np.log(np.maximum(total, 0.1) / np.maximum(width, 1e-9)), np.full(count, 0.25)
    fixed = ways(k, disp)
    for _ in range(steps):
        grid = middle[:, None] + step[:, None] * np.arange(-8, 9)
        ll = np.stack([np.bincount(own, bnb_loglik(k, np.exp(grid[own, j]) * t, np.array(gene), disp, fixed), count) for j in range(17)], axis=1)
        at = ll.argmax(axis=1)
        middle = grid[np.arange(count), at]
        step = np.where((at == 0) | (at == 16), step, step / 6)
    return np.exp(middle)


def fit_depth_dispersion(rows: DataFrame, sample: int | None = 2_000, seed: int = 0, max_rounds: int = 30, min_counts: int = 0, tolerance: float = 1e-4, fix_mean: float | None = None, fix_gene: float | None = None) -> DataFrame:
    """individual, disp and region_disp: the genome-wide dispersions of read depth, and that of all regions.

    In turn, each region's mean and one dispersion for all regions, then each
    individual's dispersion, are fitted while the likelihood grows by more than
    tolerance: Spark sums the likelihoods on grids about the last values, which
    close in.  At most sample regions take part, those of least hash (None:
    all), a documented bound; rounds are bounded too.
    """
    kind = rows.schema["individual"].dataType
    session, rows = rows.sparkSession, rows.select("region_id", "individual", "region_reads", "genome_reads").persist()  # read twice
    totals = rows.groupBy("region_id").agg(F.sum("region_reads").alias("n")).where(F.col("n") >= min_counts).select("region_id", F.md5(F.concat_ws("|", F.col("region_id").cast("string"), F.lit(str(seed)))).alias("h"))
    chosen = totals.orderBy("h", "region_id").limit(sample) if sample is not None else totals
    own = rows.join(F.broadcast(chosen.select("region_id")) if sample is not None else chosen.select("region_id"), "region_id", "left_semi")
    flat = own.where("genome_reads IS NOT NULL AND region_reads IS NOT NULL").select("region_id", F.col("individual").cast("string").alias("individual"), F.col("region_reads").cast("double").alias("k"), F.col("genome_reads").cast("double").alias("genome"))
    table = _gathered(flat, ["k", "genome"])
    table = (table.coalesce(max(session.sparkContext.defaultParallelism, 1)) if sample is not None else table).persist()
    names = _individuals(table)
    number = {x: i for i, x in enumerate(names)}
    gene, disp = math.log(fix_gene or 0.005), np.full(len(names), math.log(100.0))
    gene_step, disp_step, last = 0.3, np.full(len(names), 0.3), -math.inf
    offsets = np.arange(-SIDE, SIDE + 1)
    low, high = (math.log(1e-5), 0.0), (0.0, math.log(1e4))

    def passed(gene: float, disp: np.ndarray, gene_grid: np.ndarray | None, disp_grid: np.ndarray | None) -> dict[tuple[int, int], float]:
        """Likelihoods by individual (-1: the regions' grid) and point of the grid, at the means that suit gene and disp."""

        def make(b: pa.RecordBatch) -> dict:
            n, each = _lists(b.column("rows"))
            who, (k, genome) = np.array([number[x] for x in each.field(0).to_pylist()]), (_floats(each.field(i)) for i in (1, 2))
            least = np.repeat(np.minimum.reduceat(genome, np.cumsum(n) - n), n)
            t = np.where(least > 0, genome / np.where(least > 0, least, 1), genome)
            at, d = np.repeat(np.arange(b.num_rows), n), np.exp(disp)[who]
            mean = np.full(b.num_rows, fix_mean) if fix_mean is not None else _best_mean(k, t, d, math.exp(gene), d, at, b.num_rows)
            m = mean[at] * t
            if gene_grid is not None:
                fixed = ways(k, d)
                return {"who": np.full(len(gene_grid), -1), "p": np.arange(len(gene_grid)), "value": np.array([bnb_loglik(k, m, np.array(math.exp(g)), d, fixed).sum() for g in gene_grid])}
            ll = np.stack([np.bincount(who, bnb_loglik(k, m, np.array(math.exp(gene)), np.exp(disp_grid[:, j])[who]), len(names)) for j in range(disp_grid.shape[1])], axis=1)
            return {"who": np.repeat(np.arange(len(names)), disp_grid.shape[1]), "p": np.tile(np.arange(disp_grid.shape[1]), len(names)), "value": ll.ravel()}

        return {(r.who, r.p): r.value for r in _summed(table, ["who", "p"], make, "who long, p long, value double").collect()}  # a row per individual and point

    for _ in range(max_rounds if names else 0):
        if fix_gene is None:
            grid = np.clip(gene + gene_step * offsets, *low)
            ll = passed(gene, disp, grid, None)
            p = max(range(len(grid)), key=lambda i: (ll.get((-1, i), -math.inf), -abs(i - SIDE)))
            gene, gene_step = float(grid[p]), gene_step if p in (0, len(grid) - 1) else max(gene_step / 4, FINEST)
        grid = np.clip(disp[:, None] + disp_step[:, None] * offsets, *high)
        ll = passed(gene, disp, None, grid)
        now = 0.0
        for j in range(len(names)):
            p = max(range(grid.shape[1]), key=lambda i: (ll.get((j, i), -math.inf), -abs(i - SIDE)))  # noqa: B023
            now += ll.get((j, p), 0.0)
            disp[j], disp_step[j] = grid[j, p], disp_step[j] if p in (0, grid.shape[1] - 1) and 0 < grid[j, p] < high[1] else max(disp_step[j] / 4, FINEST)
        if now - last < tolerance and disp_step.max() <= FINEST:
            break
        last = now
    table.unpersist()
    rows.unpersist()
    out = session.createDataFrame([(n, float(math.exp(d)), math.exp(gene)) for n, d in zip(names, disp, strict=True)], "i string, disp double, region_disp double")
    return out.select(F.col("i").cast(kind).alias("individual"), "disp", "region_disp")


def fit_region_dispersion(rows: DataFrame, disp: DataFrame) -> DataFrame:
    """region_id, mean, region_disp and loglik of each region by itself, given the individuals' dispersions (individual, disp)."""
    known = rows.join(F.broadcast(disp.select("individual", F.col("disp").cast("double").alias("disp"))), "individual")  # a row per individual
    flat = known.where("genome_reads IS NOT NULL AND region_reads IS NOT NULL").select(F.col("region_id").cast("string").alias("region_id"), F.col("individual").cast("string").alias("individual"), F.col("region_reads").cast("double").alias("k"), F.col("genome_reads").cast("double").alias("genome"), "disp")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            n, each = _lists(b.column("rows"))
            k, genome, d = (_floats(each.field(i)) for i in (1, 2, 3))
            least = np.repeat(np.minimum.reduceat(genome, np.cumsum(n) - n), n)
            t = np.where(least > 0, genome / np.where(least > 0, least, 1), genome)
            none = np.zeros(0)
            data = Regions(n, np.zeros(len(k), dtype=np.int64), k, t, d, np.zeros(len(k), dtype=np.int64), none, none, none, d)
            at = np.repeat(np.arange(b.num_rows), n)
            start = np.stack([np.maximum(np.bincount(at, k, b.num_rows), 0.1) / np.maximum(np.bincount(at, t, b.num_rows), 1e-9), np.full(b.num_rows, 0.05)], axis=1)

            def cost(w: np.ndarray, y: np.ndarray, data: Regions = data) -> np.ndarray:
                bad = (y[:, 0] <= 0) | (y[:, 1] <= 0) | (y[:, 1] > 1)
                m, r = np.where(bad, 0.5, y[:, 0]), np.where(bad, 0.5, y[:, 1])
                return np.where(bad, FLAT, -data.loglik(w, m / 2, m / 2, r, np.zeros((len(w), 0)), "bnb"))

            x, value = simplex_many(cost, start)
            yield pa.RecordBatch.from_arrays([b.column("region_id"), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(-value)], names=["region_id", "mean", "region_disp", "loglik"])

    return _gathered(flat, ["k", "genome", "disp"]).mapInArrow(fit, "region_id string, mean double, region_disp double, loglik double")


#: Trial steps that a pass over the rows looks at, by their damping times the present one; passes at most; gain of a pass that ends the fit.
DAMPINGS, MOST_PASSES, GAIN = (0.01, 0.1, 1.0, 10.0), 60, 1e-6
#: Rows of an individual, one of each GC and total, up to which one task passes over all of them; those of larger ones are passed over by all tasks.
ONE_TASK = 100_000
_UPPER, _LAST = np.triu_indices(9), np.triu_indices(4)


def _depth_loss(powers: np.ndarray, depths: np.ndarray, k: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """At a point: loss, gradient, expected curvature and, where it differs, true curvature of the depth model, summed over rows of n regions and k reads."""
    reads = depths @ x[5:]
    raw = np.exp(np.clip(powers @ x[:5], -50, 50)) * reads
    e = np.maximum(raw, 1e-6)
    moves = (raw > 1e-6)[:, None] * np.concatenate([powers, depths / np.where(reads > 0, reads, 1)[:, None]], axis=1)
    curve = (moves * (n * e)[:, None]).T @ moves
    true = (moves[:, 5:] * k[:, None]).T @ moves[:, 5:]
    return np.concatenate([[float((n * e - k * np.log(e)).sum())], moves.T @ (n * e - k), curve[_UPPER], true[_LAST]])


def _depth_terms(gc: np.ndarray, total: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Powers of GC, 0 to 4, and of the total over scale, 1 to 4."""
    return np.stack([gc**i for i in range(5)], axis=1), np.stack([(total / scale) ** i for i in range(1, 5)], axis=1)


def _depth_sums(table: DataFrame, trials: dict, scale: float) -> dict:
    """_depth_loss() of each individual at its trial points, over all its rows.

    Each task adds up its own rows, so what is shuffled is 65 numbers an
    individual, trial and task.  trials: by individual, as many points each.
    """
    sent = table.sparkSession.sparkContext.broadcast(trials)  # nine numbers an individual and trial

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            codes = b.column("individual").dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            gc, tot, k, n = (b.column(c).to_numpy() for c in ("gc", "total", "reads", "n"))
            powers, depths = _depth_terms(gc, tot, scale)
            for c, name in enumerate(codes.dictionary.to_pylist()):
                if points := sent.value.get(name):
                    own = np.flatnonzero(code == c)
                    sums = known.setdefault(name, np.zeros((len(points), 65)))
                    for t, x in enumerate(points):
                        sums[t] += _depth_loss(powers[own], depths[own], k[own], n[own], x)
        rows = [(n, t, v.tolist()) for n, s in known.items() for t, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["individual", "trial", "sums"])

    rows = table.mapInArrow(run, "individual string, trial int, sums array<double>").select("individual", "trial", F.posexplode("sums").alias("i", "v"))
    found: dict = {}
    for r in rows.groupBy("individual", "trial", "i").agg(F.sum("v").alias("v")).collect():  # 65 numbers an individual and trial
        found.setdefault((r.individual, r.trial), np.zeros(65))[r.i] = r.v
    sent.unpersist()
    return found


def _depth_step(sums: np.ndarray, x: np.ndarray, damping: float, true: bool) -> np.ndarray:
    """The point that a damped step leads to from x, by the expected or the true curvature."""
    h = np.zeros((9, 9))
    h[_UPPER] = sums[10:55]
    if true:
        h[5:, 5:][_LAST] = sums[55:]
    h = h + np.triu(h, 1).T
    h[np.diag_indices(9)] += damping * np.maximum(np.diag(h), 1e-9)
    return x - np.linalg.lstsq(h, sums[1:10], rcond=None)[0]


def _depth_start(k: float, t: float, scale: float) -> np.ndarray:
    """Where the fit of k reads begins, in regions whose totals come to t: a straight line."""
    return np.array([0.0] * 5 + [k / max(t, 1) * scale, 0, 0, 0])


def _depth_fit(x: np.ndarray, most: int) -> Generator[list[np.ndarray], list[np.ndarray], tuple[np.ndarray, bool]]:
    """The fit of an individual from x on: yields the points of a pass, is sent _depth_loss() at each, and returns the best one and whether it came to rest in most passes."""
    (now,) = yield [x]
    damping, wide = [0.1, 0.1], len(DAMPINGS)
    for _ in range(most):
        trials = [_depth_step(now, x, own * d, bool(true)) for true, own in enumerate(damping) for d in DAMPINGS]
        found = yield trials
        losses = np.array([s[0] for s in found])
        losses[~np.isfinite(losses)] = math.inf
        k = int(losses.argmin())
        gain = now[0] - losses[k]
        if gain > 0:
            damping = [min(max(own * DAMPINGS[losses[true * wide : (true + 1) * wide].argmin()], 1e-12), 1e6) for true, own in enumerate(damping)]
            x, now = trials[k], found[k]
            if gain <= GAIN * abs(now[0]):
                return x, True
        else:
            damping = [100 * d for d in damping]
            if min(damping) > 1e12:
                return x, True
    return x, False


def _passed(fits: dict, sums: Callable[[dict], dict]) -> dict:
    """What fits, _depth_fit() by individual, return; sums gives what they ask for, by individual and number of the point."""
    asked, done = {n: next(f) for n, f in fits.items()}, {}
    while asked:
        found = sums(asked)
        for n, points in list(asked.items()):
            try:
                asked[n] = fits[n].send([found[n, t] for t in range(len(points))])
            except StopIteration as end:
                done[n] = end.value
                del asked[n]
    return done


def _fitted_alone(table: DataFrame, scale: float) -> list[tuple[str, np.ndarray, bool]]:
    """The fits of individuals each of whose rows one task holds: all passes in that task, over the rows in order, so that sums are the same for any partitioning."""
    most, parts = MOST_PASSES, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fit(own: pa.Table) -> pa.Table:
        own = own.sort_by([("gc", "ascending"), ("total", "ascending")])
        gc, total, k, n = (own.column(c).to_numpy() for c in ("gc", "total", "reads", "n"))
        powers, depths = _depth_terms(gc, total, scale)
        x, rests = _passed({0: _depth_fit(_depth_start(k.sum(), (total * n).sum(), scale), most)}, lambda asked: {(0, t): _depth_loss(powers, depths, k, n, x) for t, x in enumerate(asked[0])})[0]
        return pa.table({"individual": own.column("individual")[:1], "x": pa.array([x.tolist()]), "converged": [rests]})

    # fits are long and rows short, so the partitions stay as many as they are set to be
    rows = table.repartition(parts, "individual").groupBy("individual").applyInArrow(fit, "individual string, x array<double>, converged boolean").collect()  # ten values an individual
    return [(r.individual, np.array(r.x), r.converged) for r in rows]


def with_totals(rows: DataFrame) -> DataFrame:
    """rows (region_id, reads) with region_total, the reads of all individuals in the region, unless they have it."""
    return rows if "region_total" in rows.columns else rows.withColumn("region_total", F.sum("reads").over(Window.partitionBy("region_id")))


def fit_depth_model(rows: DataFrame, min_counts: int = 0, sample: int | None = None, seed: int = 0) -> DataFrame:
    """individual, coefs (ten) of expected depth, exp(quartic of GC) times a polynomial of the region's total, and converged.

    rows: region_id, individual, gc, reads, and region_total where it is known
    (with_totals()).  Fitted by Poisson likelihood on all regions (or on at most sample of them,
    those of least hash): each pass over the rows sums loss, gradient and
    curvatures at some points of each individual, and damped steps, by the
    expected and by the true curvature, lead on from the best, until the
    individual gains no more than a millionth of its loss.  An individual of up
    to ONE_TASK different GC and totals is passed over in one task, which holds
    them; the passes of all larger ones are made together, by Spark.  One that
    still gains after MOST_PASSES, as where too few reads leave some
    coefficients without a finite best value, has the best point so far and is
    not converged.
    """
    known = with_totals(rows).withColumn("total", F.col("region_total")).where(F.col("gc").isNotNull() & F.col("reads").isNotNull() & (F.col("total") >= max(min_counts, 1)))
    if sample is not None:
        regions = known.select("region_id").distinct().withColumn("h", F.md5(F.concat_ws("|", F.col("region_id").cast("string"), F.lit(str(seed))))).orderBy("h", "region_id").limit(sample)
        known = known.join(F.broadcast(regions.select("region_id")), "region_id", "left_semi")
    table = known.select(F.col("individual").cast("string").alias("individual"), *(F.col(c).cast("double").alias(c) for c in ("gc", "total", "reads")))
    # the sums are linear in reads, so an individual's regions of one GC and total are one row
    table = table.groupBy("individual", "gc", "total").agg(F.sum("reads").alias("reads"), F.count("*").cast("double").alias("n")).persist()
    begin = table.groupBy("individual").agg(F.sum("reads").alias("k"), F.sum(F.col("total") * F.col("n")).alias("t"), F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # a row per individual
    scale = sum(r.t for r in begin) / max(sum(r.n for r in begin), 1) or 1.0
    large = {r.individual: _depth_fit(_depth_start(r.k, r.t, scale), MOST_PASSES) for r in begin if r.rows > ONE_TASK}
    is_large = F.when(F.col("individual").isNull(), F.lit(None in large)).otherwise(F.col("individual").isin([n for n in large if n is not None]))
    out = _fitted_alone(table.where(~is_large), scale) if len(large) < len(begin) else []
    if large:
        wide = table.where(is_large)
        out += [(n, x, rests) for n, (x, rests) in _passed(large, lambda asked: _depth_sums(wide, asked, scale)).items()]
    table.unpersist()
    out = [(n, [*map(float, x[:5]), 0.0, *(float(v / scale**i) for i, v in enumerate(x[5:], 1))], rests) for n, x, rests in out]
    kind = rows.schema["individual"].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, "individual string, coefs array<double>, converged boolean").select(F.col("individual").cast(kind), "coefs", "converged")


def apply_depth_model(rows: DataFrame, coefs: DataFrame) -> DataFrame:
    """rows (region_id, individual, gc, reads, and region_total where it is known) with expected depth, at least 1e-6."""
    from ..functions.likelihood import expected_depth

    c = [F.get(F.col("coefs"), F.lit(i)) for i in range(10)]
    return with_totals(rows).withColumn("total", F.col("region_total").cast("double")).join(F.broadcast(coefs.select("individual", "coefs")), "individual", "left").withColumn("expected", F.greatest(expected_depth(F.col("gc"), F.col("total"), c), F.lit(1e-6))).drop("coefs", *{"region_total"}.difference(rows.columns))


#: Rows of a stretch of ranks that one task numbers, while stretches are not more than MOST_STRETCHES; beyond, they grow with the table.
STRETCH, MOST_STRETCHES = 250_000, 10_000


def _stretched(df: DataFrame, p: str, key: str, stretch: int) -> DataFrame:
    """df with _s: the stretch of the order by p and key that a row lies in.

    Stretches are Spark's ranges of the order, so rows that share a p are dealt
    out by key.  They are written down, as ranges that are worked out again may
    be cut elsewhere.
    """
    n = df.count()
    count = min(-(-n // stretch), MOST_STRETCHES)
    if count < 2:
        return df.withColumn("_s", F.lit(0))
    path = folder(df.sparkSession, "ranges")
    cut = df.repartitionByRange(count, F.asc_nulls_first(p), F.col(key)).withColumn("_s", F.spark_partition_id())
    cut.write.parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def _by_stretch(df: DataFrame, values: dict[int, object], name: str, kind: str) -> DataFrame:
    """df with a value by stretch, of which there are at most MOST_STRETCHES."""
    rows = df.sparkSession.createDataFrame(list(values.items()), f"_s int, {name} {kind}")
    return df.join(F.broadcast(rows), "_s", "left")


def ranked(df: DataFrame, p: str, key: str = "region_id", stretch: int = STRETCH) -> tuple[DataFrame, int]:
    """df with _s and _rank: the place, from 1, in the order by p and then key; and the number of rows.

    Each stretch of the order is numbered by itself and moved on by the rows of those before.
    """
    cut = _stretched(df, p, key, stretch)
    sizes = {r._s: r["count"] for r in cut.groupBy("_s").count().collect()}  # a row per stretch
    before, at = {}, 0
    for s in sorted(sizes):
        before[s] = at
        at += sizes[s]
    out = _by_stretch(cut, before, "_before", "long")
    return out.withColumn("_rank", F.row_number().over(Window.partitionBy("_s").orderBy(p, key)) + F.col("_before")).drop("_before"), at


def expected_ranks(results: DataFrame, p: str = "p_value", stretch: int = STRETCH) -> DataFrame:
    """results with the uniform quantile of each p by rank, and -log10 of both; p counts as 1e-20 at least."""
    out, n = ranked(results, p, stretch=stretch)
    out = out.withColumn("expected", F.col("_rank") / max(n, 1)).drop("_rank", "_s")
    return out.withColumns({"log_p": -F.log10(F.greatest(p, F.lit(1e-20))), "log_expected": -F.log10("expected")})


def false_discovery(results: DataFrame, p: str = "p_value", stretch: int = STRETCH) -> DataFrame:
    """results with fdr: Benjamini and Hochberg's adjusted p; a p of 0 counts as the least above it.

    The least p * n / rank from a row on is that of its own stretch from there
    on, or of a later stretch.
    """
    least = results.agg(F.min(F.when(F.col(p) > 0, F.col(p)))).first()[0]
    own, n = ranked(results.withColumn("_p", F.when(F.col(p) > 0, F.col(p)).otherwise(F.lit(least).cast("double"))), "_p", stretch=stretch)
    own = own.withColumn("_q", F.col("_p") * n / F.col("_rank"))
    mins = {r._s: r.q for r in own.groupBy("_s").agg(F.min("_q").alias("q")).collect()}  # a row per stretch
    after, low = {}, math.inf
    for s in sorted(mins, reverse=True):
        after[s] = low
        low = min(low, mins[s] if mins[s] is not None else math.inf)
    from_here = F.min("_q").over(Window.partitionBy("_s").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0))
    return _by_stretch(own, after, "_after", "double").withColumn("fdr", F.least(from_here, F.col("_after"), F.lit(1.0))).drop("_p", "_q", "_rank", "_s", "_after")


def every_other(rows: DataFrame, skip: int, place: str = "test_pos", key: str = "region_id") -> DataFrame:
    """rows of the regions that are left when so many are passed over before each one, in the order of place and key."""
    if skip < 0:
        raise ValueError("skip must not be negative")
    numbered, _ = ranked(rows.select(place, key).distinct(), place, key)
    return rows.join(numbered.where(F.pmod(F.col("_rank") - 1, F.lit(skip + 1)) == skip).select(key), key, "left_semi")


def count_matrix(rows: DataFrame, value: str, names: list) -> DataFrame:
    """region_id and a column of value for each individual of names; what is missing is null."""
    return rows.groupBy("region_id").pivot("individual", names).agg(F.first(value))


def power_rates(results: DataFrame, by: tuple[str, ...], level: float = 0.1) -> DataFrame:
    """For each group: n, calls (fdr <= level), true positives and negatives, and their rates; truth is is_effect."""
    call = F.col("fdr") <= level
    n = results.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(call).alias("calls"), F.count_if(call & F.col("is_effect")).alias("true_positive"), F.count_if(~call & ~F.col("is_effect")).alias("true_negative"), F.count_if("is_effect").alias("effects"))
    return n.withColumns({"sensitivity": F.col("true_positive") / F.when(F.col("effects") > 0, F.col("effects")), "specificity": F.col("true_negative") / F.when(F.col("n") > F.col("effects"), F.col("n") - F.col("effects")), "false_share": (F.col("calls") - F.col("true_positive")) / F.when(F.col("calls") > 0, F.col("calls"))})


def loadings(rows: DataFrame, value: str = "reads", components: int | None = None) -> DataFrame:
    """individual, component (from 1) and loading of the principal components of regions by individuals, centred.

    Each task sums the individuals' products over its regions; only that matrix, individuals squared, is decomposed.
    """
    wide = rows.select("region_id", F.col("individual").cast("string").alias("individual"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    table = _gathered(wide, ["v"]).persist()
    names = _individuals(table)
    at = {x: i for i, x in enumerate(names)}
    n = len(names)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, sa, both = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n))
        for b in _pieces(batches):
            m, each = _lists(b.column("rows"))
            x, here = np.zeros((b.num_rows, n)), np.zeros((b.num_rows, n))
            where = np.repeat(np.arange(b.num_rows), m), np.array([at[y] for y in each.field(0).to_pylist()], dtype=np.int64)
            x[where], here[where] = _floats(each.field(1)), 1
            s += x.T @ x
            sa += x.T @ here
            both += here.T @ here
        a, b = np.divmod(np.arange(n * n), max(n, 1))
        yield pa.RecordBatch.from_pydict({"a": a, "b": b, "s": s.ravel(), "sa": sa.ravel(), "sb": sa.T.ravel(), "n": both.ravel()})

    sums = table.mapInArrow(products, "a long, b long, s double, sa double, sb double, n double").groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("s", "sa", "sb", "n")))
    c = np.zeros((n, n))
    for r in sums.collect():  # a row per two individuals
        c[r.a, r.b] = (r.s - r.sa * r.sb / r.n) / max(r.n - 1, 1) if r.n else 0.0
    table.unpersist()
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)[: components or n]
    turn = [1.0 if vectors[np.abs(vectors[:, j]).argmax(), j] > 0 else -1.0 for j in order]
    out = [(x, k + 1, float(vectors[i, j] * turn[k])) for k, j in enumerate(order) for i, x in enumerate(names)]
    return rows.sparkSession.createDataFrame(out, "i string, component int, loading double").select(F.col("i").cast(rows.schema["individual"].dataType).alias("individual"), "component", "loading")


#: Further columns that leading_loadings carries, how small what is left of a component must be, and passes at most.
OVERSAMPLE, RESIDUE, MOST_TURNS = 8, 1e-8, 300


def leading_loadings(rows: DataFrame, value: str = "reads", components: int = 3, seed: int = 0) -> DataFrame:
    """individual, component (from 1) and loading of the leading principal components, for many individuals.

    Block power iteration from a random start: a pass multiplies the covariance
    of the individuals by a few columns without ever making it, each task over
    its own regions, so that tasks and driver hold as many columns and no
    product of individuals.  It ends when what the covariance makes of each
    component differs from a multiple of it by RESIDUE of the largest at most;
    after MOST_TURNS passes that is an error.  What is missing counts as its
    individual's mean (loadings() leaves it out of each product instead).
    """
    wide = rows.select("region_id", F.col("individual").cast("string").alias("individual"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    means = {r.individual: r.m for r in wide.groupBy("individual").agg(F.avg("v").alias("m")).collect()}  # a row per individual
    kind = rows.schema["individual"].dataType
    names = sorted(means)
    n, m = len(names), wide.select("region_id").distinct().count()
    k, carried = min(components, n), min(components + OVERSAMPLE, n)
    if not n:
        return rows.sparkSession.createDataFrame([], "i string, component int, loading double").select(F.col("i").cast(kind).alias("individual"), "component", "loading")
    table = _gathered(wide, ["v"]).persist()
    spark = rows.sparkSession.sparkContext
    fixed = spark.broadcast(({x: i for i, x in enumerate(names)}, np.array([means[x] for x in names])))

    def multiplied(q: np.ndarray) -> np.ndarray:
        sent = spark.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (at, centre), columns = fixed.value, sent.value
            z = np.zeros(columns.shape)
            for b in _pieces(batches):
                size, each = _lists(b.column("rows"))
                who = np.array([at[y] for y in each.field(0).to_pylist()], dtype=np.int64)
                region, x = np.repeat(np.arange(b.num_rows), size), _floats(each.field(1)) - centre[who]
                own = np.zeros((b.num_rows, columns.shape[1]))
                np.add.at(own, region, x[:, None] * columns[who])
                np.add.at(z, who, x[:, None] * own[region])
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(z)), pa.int32()), "z": pa.array(z.tolist(), pa.list_(pa.float64()))})

        parts = table.mapInArrow(run, "i int, z array<double>").select("i", F.posexplode("z").alias("j", "v"))
        out = np.zeros(q.shape)
        for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # individuals by columns
            out[r.i, r.j] = r.v
        sent.unpersist()
        return out / max(m - 1, 1)

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, carried)))[0]
    for _ in range(MOST_TURNS):
        z = multiplied(q)
        values, turn = np.linalg.eigh(q.T @ z)
        best = np.argsort(-values)[:k]
        vectors, made = q @ turn[:, best], z @ turn[:, best]
        left = np.linalg.norm(made - vectors * values[best], axis=0).max(initial=0.0)
        if left <= RESIDUE * max(abs(values).max(), 1e-300):
            break
        q = np.linalg.qr(z)[0]
    else:
        raise ValueError(f"the components have not come to rest after {MOST_TURNS} passes")
    table.unpersist()
    signs = [1.0 if vectors[np.abs(vectors[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    out = [(x, j + 1, float(vectors[i, j] * signs[j])) for j in range(k) for i, x in enumerate(names)]
    return rows.sparkSession.createDataFrame(out, "i string, component int, loading double").select(F.col("i").cast(kind).alias("individual"), "component", "loading")
