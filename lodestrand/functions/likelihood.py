"""Likelihoods as Column expressions: Spark has no lgamma, so it is built from its asymptotic series."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ASYMPTOTIC = 1e6
READ_ERROR = 0.005
GENOTYPE_ERROR = 0.01


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(values: Column, f: Callable[[Column], Column]) -> Column:
    """f of values, which are worked out once however often f uses them."""
    return F.get(F.transform(F.array(values), f), F.lit(0))


def _series(x: Column) -> Column:
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return let(1 / y, lambda v: (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + v * (1 / 12 - v * v * (1 / 360 - v * v * (1 / 1260 - v * v / 1680)))) - F.log(product)


def lgamma(x: Column | float) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, brought back by a product."""
    return let(_col(x).cast("double"), _series)


def lbeta(a: Column | float, b: Column | float) -> Column:
    """ln Beta(a, b); where one argument is very large, by the series in its inverse, which does not cancel."""

    def far(large: Column, small: Column) -> Column:
        q = small * (1 - small)
        return lgamma(small) - small * F.log(large) + q / (2 * large) + q * (1 - 2 * small) / (12 * large * large) - q * q / (12 * large * large * large)

    a, b = _col(a).cast("double"), _col(b).cast("double")
    pair = F.struct(F.greatest(a, b).alias("large"), F.least(a, b).alias("small"))
    return let(pair, lambda p: F.when(p["large"] < ASYMPTOTIC, lgamma(p["large"]) + lgamma(p["small"]) - lgamma(p["large"] + p["small"])).otherwise(far(p["large"], p["small"])))


def add_logs(a: Column, b: Column) -> Column:
    """ln(exp a + exp b)."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.greatest(p["a"], p["b"]) + F.log1p(F.exp(-F.abs(p["a"] - p["b"]))))


def allele_error(ref: Column, alt: Column, error: float = READ_ERROR) -> Column:
    """Log-likelihood of counts at a site that is homozygous after all, up to the factor that is left out throughout."""
    e, k = math.log(error), math.log(1 - error)
    return add_logs(ref * e + alt * k, ref * k + alt * e)


def beta_binomial(p: Column | float, sigma: Column, ref: Column, alt: Column, het_prob: Column, error: float = READ_ERROR) -> Column:
    """Log-likelihood of allele counts, for a site that is heterozygous with probability het_prob."""
    p = _col(p)
    scale = 1 / (sigma * sigma) - 1
    shape = F.struct((p * scale).alias("a"), ((1 - p) * scale).alias("b"))
    own = let(shape, lambda s: lbeta(ref + s["a"], alt + s["b"]) - lbeta(s["a"], s["b"]))
    both = F.struct(own.alias("own"), allele_error(ref, alt, error).alias("wrong"))
    return let(both, lambda x: F.when(het_prob == 1, x["own"]).when(het_prob == 0, x["wrong"]).otherwise(add_logs(F.log(het_prob) + x["own"], F.log(1 - het_prob) + x["wrong"])))


def beta_negative_binomial(k: Column, mean: Column, sigma: Column, n: Column) -> Column:
    """Log-likelihood of a read count k with a mean, an overdispersion sigma of the region and n of the genome."""

    def at(v: Column) -> Column:
        p, k, n, sigma = v["p"], v["k"], v["n"], v["sigma"]
        plain = -lbeta(n, k + 1) - F.log(n + k) + n * F.log(p) + k * F.log1p(-p)
        scale = 1 / (sigma * sigma)
        a, b = p * scale + 1, (1 - p) * scale
        own = F.when(k > 0, -lbeta(n, F.greatest(k, F.lit(1.0))) - F.log(F.greatest(k, F.lit(1.0)))).otherwise(0.0) + lbeta(a + n, b + k) - lbeta(a, b)
        return F.when(sigma < 1e-5, plain).otherwise(own)

    return let(F.struct((n / (n + F.greatest(mean, F.lit(1e-5)))).alias("p"), k.cast("double").alias("k"), n.cast("double").alias("n"), sigma.cast("double").alias("sigma")), at)


def het_posterior(prior: Column, ref: Column, alt: Column, error: float = GENOTYPE_ERROR) -> Column:
    """Probability that a site is heterozygous, given counts of its alleles."""
    prior = F.least(prior, F.lit(0.99))
    bad = allele_error(ref, alt, error)
    good = math.log(0.5) * (ref + alt)
    odds = prior * F.exp(F.least(good - bad, F.lit(40.0)))
    return F.when(good - bad > 40, F.lit(1.0)).otherwise(odds / (odds + 1 - prior))


def expected_depth(gc: Column, total: Column, coefs: list[Column]) -> Column:
    """Expected reads of a region: exp(quartic of GC) * (cubic of the total, from its first power to its fourth).

    Ten coefficients; that of the zeroth power of the total is carried but not used.
    """
    shape, reads = F.lit(0.0), F.lit(0.0)
    for i in range(5):
        shape = shape + coefs[i] * F.pow(gc, F.lit(i))
    for i in range(1, 5):
        reads = reads + coefs[5 + i] * F.pow(total, F.lit(i))
    return F.exp(shape) * reads


def covariate_factor(coefs: Column, values: Column) -> Column:
    """1 plus the sum of coefficients times covariates (arrays)."""
    return F.lit(1.0) + F.aggregate(F.zip_with(coefs, values, lambda c, v: c * v), F.lit(0.0), lambda s, x: s + x)
