"""Simulators: counts for the combined test, power grids, read pairs from two haplotypes.

Each row draws from a generator seeded by its own number, so results do not
depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import substitute

ROW = "region_id string, chrom string, test_pos long, individual string, genotype double, haplotype string, region_snps array<struct<pos:bigint,het_prob:double,linkage:double,ref_n:bigint,alt_n:bigint,other_n:bigint>>, region_reads long, genome_reads double, is_effect boolean, allele_freq double, effect double"


def simulate_counts(spark: SparkSession, n_tests: int = 10_000, n_inds: int = 10, mean: float = 200.0, as_share: float = 0.1, allele_freq: float = 0.2, effect: float = 1.0, effect_share: float = 0.0, depth_disp: float = 100.0, gene_disp: float = 0.05, as_disp: float = 0.2, het_error: float = 0.0, seed: int = 1, poisson: bool = False) -> DataFrame:
    """Rows of the combined test: a read count and one site's allele counts for each region and individual.

    Reads of the alternate allele are effect times those of the reference in
    the share of regions with an effect.  Depth is beta-negative-binomial and
    alleles beta-binomial, or Poisson and binomial.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["id"]:
                g = np.random.default_rng([seed, int(t)])
                has = bool(g.random() < effect_share)
                alpha, beta = 1.0, effect if has else 1.0
                for i in range(n_inds):
                    haps = (g.random(2) < allele_freq).astype(int)
                    dose = int(haps.sum())
                    m = mean * {0: 2 * alpha, 1: alpha + beta, 2: 2 * beta}[dose] / 2
                    if poisson:
                        reads = int(g.poisson(m))
                    else:
                        p = depth_disp / (depth_disp + m)
                        s = 1 / gene_disp**2
                        q = min(max(float(g.beta(p * s + 1, (1 - p) * s)), 1e-12), 1 - 1e-12)
                        reads = int(g.negative_binomial(depth_disp, q))
                    n = int(g.binomial(reads, as_share))
                    p = alpha / (alpha + beta) if dose == 1 else 0.5
                    if not poisson:
                        s = 1 / as_disp**2 - 1
                        p = float(g.beta(p * s, (1 - p) * s))
                    first = int(g.binomial(n, p)) if dose == 1 else (n if dose == 0 else 0)
                    het = 1 - het_error if dose == 1 else het_error
                    pos = int(t) * 1000 + 1
                    out.append((f"t{t}", "chr1", pos, f"i{i:03d}", float(dose), "|".join(map(str, sorted(haps.tolist()))), [(pos, float(het), 1.0, first, n - first, 0)], reads, mean * 1000.0, has, allele_freq, effect))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    return spark.range(n_tests).mapInPandas(run, ROW)


def power_grid(spark: SparkSession, sizes: tuple[int, ...] = (10, 20, 30, 40, 50, 100)) -> DataFrame:
    """sim_id, n_inds, allele_freq and effect of each simulation: ten allele frequencies at one effect and eleven effects at one frequency.

    Steps are whole numbers over a scale, so that no step adds a rounding error.
    """
    size = spark.createDataFrame([(n,) for n in sizes], "n_inds int")
    freqs = size.select("n_inds", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k")).select("n_inds", (F.col("k") * 5 / 100).alias("allele_freq"), F.lit(1.5).alias("effect"), F.lit("allele_freq").alias("varied"))
    effects = size.select("n_inds", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k")).select("n_inds", F.lit(0.2).alias("allele_freq"), ((100 + F.col("k") * 20) / 100).alias("effect"), F.lit("effect").alias("varied"))
    return freqs.unionByName(effects)


def haplotype_chunks(chunks: DataFrame, haps: DataFrame, chunk: int = 10_000) -> DataFrame:
    """chrom, chunk_start, hap (1 or 2), bases and sites: both copies of the sequence with the variants of haps (chrom, pos, ref, alt, hap1, hap2), one base each, and the positions at which the copies differ."""
    site = haps.withColumns({"chunk_start": (F.floor((F.col("pos") - 1) / chunk) * chunk + 1).cast("long")})
    lists = site.groupBy("chrom", "chunk_start").agg(F.sort_array(F.collect_list(F.struct("pos", "alt", "hap1", "hap2"))).alias("s"))
    both = chunks.join(lists, ["chrom", "chunk_start"], "left").withColumn("hap", F.explode(F.array(F.lit(1), F.lit(2))))
    own = F.filter(F.coalesce("s", F.array().cast(lists.schema["s"].dataType)), lambda s: F.when(F.col("hap") == 1, s["hap1"]).otherwise(s["hap2"]) == 1)
    return both.select("chrom", "chunk_start", "hap", F.aggregate(own, F.col("bases"), lambda b, s: substitute(b, (s["pos"] - F.col("chunk_start") + 1).cast("int"), s["alt"])).alias("bases"), F.transform(F.filter(F.coalesce("s", F.array().cast(lists.schema["s"].dataType)), lambda s: s["hap1"] != s["hap2"]), lambda s: s["pos"].cast("long")).alias("sites"))


READ = "qname string, hap int, pos_a long, pos_b long, seq_a string, seq_b string"


def _start(g: np.random.Generator, site: int, size: int, read_len: int, length: int) -> tuple[int, int]:
    """A fragment's start and size such that one of its two end reads, by a coin, covers a place of a sequence.

    Where neither end can, so near to an end of the sequence, the fragment is one read long.
    """
    ends = [0, size - read_len]
    if g.integers(0, 2):
        ends.reverse()
    for shift, long in (*((e, size) for e in ends), (0, read_len)):
        low, high = max(0, site - shift - (length - long)), min(read_len - 1, site - shift)
        if low <= high:
            return site - shift - int(g.integers(low, high + 1)), long
    raise ValueError("the place is not in the sequence")


def simulate_reads(copies: DataFrame, per_chunk: int, read_len: int = 36, insert_mean: float = 100.0, insert_sd: float = 50.0, seed: int = 1) -> DataFrame:
    """Read pairs of copies (chrom, chunk_start, hap, bases): per_chunk fragments of each chunk, of normal length, both ends read.

    The second read is on the other strand.  Where copies have sites (as those
    of haplotype_chunks), one read of each fragment covers one of them, drawn at
    random, and a chunk without any gives no fragment.
    """
    forced = "sites" in copies.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = str.maketrans("ACGTNacgtn", "TGCANtgcan")
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                sites = r.sites if forced and r.sites is not None else ()
                g = np.random.default_rng([seed, r.chunk_start, r.hap, sum(r.chrom.encode())])
                ends = min(read_len, len(r.bases))
                for i in range(per_chunk if len(sites) or not forced else 0):
                    size = min(max(int(g.normal(insert_mean, insert_sd)), ends), len(r.bases))
                    if forced:
                        at, size = _start(g, int(sites[g.integers(0, len(sites))]) - r.chunk_start, size, ends, len(r.bases))
                    else:
                        at = int(g.integers(0, len(r.bases) - size + 1))
                    piece = r.bases[at : at + size]
                    out.append((f"{r.chrom}:{r.chunk_start}:{r.hap}:{i}", r.hap, r.chunk_start + at, r.chunk_start + at + size - ends, piece[:ends], piece[-ends:].translate(turn)[::-1]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")])

    return copies.mapInPandas(run, READ)
