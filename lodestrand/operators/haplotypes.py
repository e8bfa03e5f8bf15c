"""Rows for the combined test: counts of each haplotype at the heterozygous sites of a region."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .remap import hash_order

MODES = ("zero", "rand_hap", "rand_allele")


#: Positions of a bin: the regions of a bin meet the sites and reads of the bins that they reach into in one group.
BIN = 256
_SITE = pa.struct([("pos", pa.int64()), ("het_prob", pa.float64()), ("linkage", pa.float64()), ("ref_n", pa.int64()), ("alt_n", pa.int64()), ("other_n", pa.int64())])
SITE = "struct<pos:bigint,het_prob:double,linkage:double,ref_n:bigint,alt_n:bigint,other_n:bigint>"


def _whole(column: pa.ChunkedArray, none: float = 0) -> np.ndarray:
    return column.combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """How many members the lists of a column have (null: none), and all members."""
    whole = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] places, for all i in turn."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _merged(region: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts in order, those of a region that meet or overlap made one, so that no place comes twice."""
    out: list[list[int]] = []
    for r, a, z in sorted(zip(region.tolist(), start.tolist(), stop.tolist(), strict=True)):
        if z < a:
            continue
        if out and out[-1][0] == r and a <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], z)
        else:
            out.append([r, a, z])
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 3).T)


def _cut(regions: pa.Table, cells: pa.Table, mode: str, seed: int, likely: bool) -> pa.Table:
    """What region_lists() gives of the regions of a bin."""
    codes = cells.column("individual").combine_chunks().dictionary_encode()
    who, pos = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), _whole(cells.column("pos")).astype(np.int64)
    low = int(pos.min(initial=0))
    span = int(pos.max(initial=0)) - low + 2
    key = who * span + pos - low
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    hap1, hap2 = (_whole(cells.column(c), -1)[order].astype(np.int64) for c in ("hap1", "hap2"))
    known = _whole(cells.column("known"), False).astype(bool)[order]
    ref, alt, other, reads = (_whole(cells.column(c))[order].astype(np.int64) for c in ("ref_n", "alt_n", "other_n", "n"))
    het = np.flatnonzero((hap1 >= 0) & (hap2 >= 0) & (hap1 != hap2))
    upto = np.concatenate(([0], np.cumsum(reads)))
    count, wide = regions.num_rows, len(codes.dictionary)
    individual = np.arange(wide)
    at = lambda keys, w, x: np.searchsorted(keys, w * span + np.clip(x - low, 0, span - 1))  # noqa: E731  how many keys lie before x
    n_parts, starts = _lists(regions.column("starts"))
    region = np.repeat(np.arange(count), n_parts)
    start, stop = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, _lists(regions.column("stops"))[1]))
    # depth of each region and individual, over all parts as they are
    w = individual[None, :]
    some = np.maximum(upto[at(key, w, (stop + 1)[:, None])] - upto[at(key, w, start[:, None])], 0)
    depth = np.zeros((count, wide), dtype=np.int64)
    np.add.at(depth, region, some)
    # sites, in the order of region, individual and part
    region, start, stop = _merged(region, start, stop)
    first, last = at(key[het], w, start[:, None]), at(key[het], w, (stop + 1)[:, None])
    row = (region[:, None] * wide + w).ravel()
    turn = np.argsort(row, kind="stable")
    size = (last - first).ravel()[turn]
    site = het[_ragged(first.ravel()[turn], size)]
    own = np.repeat(row[turn], size)
    sizes = np.bincount(own, minlength=count * wide)
    # the genotype at the test site
    test = _whole(regions.column("test_pos")).astype(np.int64)
    there = np.minimum(at(key, w, test[:, None]), max(len(key) - 1, 0)).ravel()
    met = ((key[there] == (w * span + (test - low)[:, None]).ravel()) & known[there]) & np.repeat((test >= low) & (test < low + span - 1), wide)
    own1, own2 = np.where(met, hap1[there], -1), np.where(met, hap2[there], -1)
    test_het = (own1 >= 0) & (own2 >= 0) & (own1 != own2)
    same = np.where(own1[own] == 0, hap1[site] == 0, hap2[site] == 0)
    r, a = ref[site], alt[site]
    free = np.zeros_like(r), np.zeros_like(r)
    if mode != "zero":
        names, ids = codes.dictionary.cast(pa.string()).to_pylist(), regions.column("region_id").cast(pa.string()).to_pylist()
        coin = lambda *x: int(hashlib.md5("|".join((*x, str(seed))).encode()).hexdigest()[0], 16) % 2 == 1
        if mode == "rand_hap":
            flip = np.array([coin(ids[i], names[j]) for i in range(count) for j in range(wide)], dtype=bool)[own]
            x, y = np.where(hap1[site] == 0, r, a), np.where(hap1[site] == 0, a, r)
        else:
            flip = np.array([coin(ids[k // wide], names[k % wide], str(p)) for k, p in zip(own.tolist(), pos[site].tolist(), strict=True)], dtype=bool)
            x, y = r, a
        free = np.where(flip, y, x), np.where(flip, x, y)
    told = test_het[own]
    chance = pa.array(np.ones(len(site)))
    if likely:
        chance = cells.column("p_ra").combine_chunks().take(pa.array(order[site]))
    fields = [pa.array(pos[site]), chance, pa.array(np.ones(len(site))), pa.array(np.where(told, np.where(same, r, a), free[0])), pa.array(np.where(told, np.where(same, a, r), free[1])), pa.array(other[site])]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(_SITE)), mask=pa.array(sizes == 0))
    out = regions.take(pa.array(np.repeat(np.arange(count), wide)))
    whose = codes.dictionary.take(pa.array(np.tile(individual, count)))
    hap = lambda x: pa.array(x, pa.int64(), mask=x < 0)
    for name, values in (("individual", whose), ("known", pa.array(met)), ("hap1", hap(own1)), ("hap2", hap(own2)), ("region_snps", lists), ("region_n", pa.array(depth.ravel()))):
        out = out.append_column(name, values)
    return out


def region_lists(regions: DataFrame, genotypes: DataFrame, as_counts: DataFrame | None, depth: DataFrame | None = None, mode: str = "zero", seed: int = 0, probabilities: DataFrame | None = None, width: int = BIN) -> DataFrame:
    """A row per region and individual: the region's columns, individual, known, hap1, hap2 (at the test site), region_snps and region_n.

    regions: region_id, chrom, test_pos, starts and stops (of its parts), and
    more.  genotypes: chrom, pos, individual, hap1, hap2.  as_counts: chrom,
    site, individual, ref_n, alt_n, other_n (None: no counts).  depth: chrom,
    pos, individual, n.
    region_snps are the heterozygous sites in the parts, by position (pos,
    het_prob, linkage, ref_n, alt_n, other_n), null if there are none: counts
    of the haplotype with the test site's reference allele, and of the other
    one.  Where the test site is not heterozygous mode says: zero counts, a
    haplotype by a coin that falls once for a region and individual
    (rand_hap), or an allele by one that falls for each site (rand_allele).
    known tells whether the individual has a genotype at the test site, and
    region_n sums the depth over the parts.  A missing allele makes no
    heterozygote.  probabilities (chrom, pos, individual, p_ra): how likely each
    individual is heterozygous at a site; without them 1.

    Genotypes and counts are brought together once for each place, and go to
    the bins of regions that reach them; there the sites of each region are cut
    from them at once, so no site is shuffled for each region that it lies in.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    at, counted = ["chrom", "pos", "individual"], ("ref_n", "alt_n", "other_n")
    kinds = {"hap1": "int", "hap2": "int", "known": "boolean", "p_ra": "double", "ref_n": "long", "alt_n": "long", "other_n": "long", "n": "long"}

    def cells_of(table: DataFrame, place: str, *have: str) -> DataFrame:
        return table.select("chrom", F.col(place).cast("long").alias("pos"), "individual", *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    cells = cells_of(genotypes.withColumn("known", F.lit(True)), "pos", "hap1", "hap2", "known")
    if as_counts is not None:
        cells = cells.unionByName(cells_of(as_counts, "site", *counted))
    if depth is not None:
        cells = cells.unionByName(cells_of(depth, "pos", "n"))
    if probabilities is not None:
        cells = cells.unionByName(cells_of(probabilities, "pos", "p_ra"))
    cells = cells.groupBy(*at).agg(*(F.max(c).alias(c) for c in ("hap1", "hap2", "known", "p_ra")), *(F.sum(c).alias(c) for c in (*counted, "n"))).where("known OR n > 0")

    home = F.floor(F.col("test_pos") / width).alias("_home")
    reached = F.flatten(F.transform(F.arrays_zip("starts", "stops"), lambda p: F.when(p["stops"] >= p["starts"], F.sequence(F.floor(p["starts"] / width), F.floor(p["stops"] / width))).otherwise(F.array().cast("array<bigint>"))))
    needs = regions.select("chrom", home, F.explode(F.array_distinct(F.concat(F.array(home), reached))).alias("_bin")).distinct()
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = cells.withColumn("_bin", F.floor(F.col("pos") / width)).join(needs, ["chrom", "_bin"]).drop("_bin").repartition(parts, "chrom", "_home")
    placed = regions.withColumn("_home", home).repartition(parts, "chrom", "_home")
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"`{c}` {kind(regions, c)}" for c in regions.columns), f"individual {kind(genotypes, 'individual')}", f"known boolean, hap1 long, hap2 long, region_snps array<{SITE}>, region_n long"])
    likely = probabilities is not None

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cut(left.drop_columns(["_home"]), right, mode, seed, likely)

    return placed.groupBy("chrom", "_home").cogroup(near.groupBy("chrom", "_home")).applyInArrow(cut, schema)


def dosage(p_ra: Column, p_aa: Column) -> Column:
    """Expected number of alternate alleles."""
    return p_ra + 2.0 * p_aa


def input_rows(regions: DataFrame, genotypes: DataFrame, as_counts: DataFrame, depth: DataFrame, genome: DataFrame, mode: str = "zero", seed: int = 0) -> DataFrame:
    """The rows of the combined test: region columns, individual, genotype, haplotype, region_snps, region_reads, genome_reads.

    As region_lists(), for individuals that have a genotype at the test site;
    genome: individual, genome_n.
    """
    rows = region_lists(regions, genotypes, as_counts, depth, mode, seed).where("known")
    called = F.col("hap1").isNotNull() & F.col("hap2").isNotNull()
    rows = rows.withColumns({"genotype": (F.col("hap1") + F.col("hap2")).cast("double"), "haplotype": F.when(called, F.concat_ws("|", F.col("hap1").cast("string"), F.col("hap2").cast("string"))), "region_reads": F.col("region_n")})
    return rows.join(F.broadcast(genome), "individual", "left").withColumn("genome_reads", F.col("genome_n")).drop("known", "hap1", "hap2", "region_n", "genome_n")  # a row per individual


def region_depth(regions: DataFrame, genotypes: DataFrame, depth: DataFrame) -> DataFrame:
    """region_id, individual and region_reads of the rows of input_rows(), for which neither alleles nor reads at sites are looked at."""
    none = F.lit(None).cast("int")
    bare = genotypes.select("chrom", "pos", "individual", none.alias("hap1"), none.alias("hap2"))
    rows = region_lists(regions.select("region_id", "chrom", "test_pos", "starts", "stops"), bare, None, depth)
    return rows.where("known").select("region_id", "individual", F.col("region_n").alias("region_reads"))


def first_per_position(snps: Column) -> Column:
    """region_snps by position, the first of each."""
    ordered = F.array_sort(snps)
    return F.filter(ordered, lambda s, i: (i == 0) | (F.get(ordered, i - 1)["pos"] != s["pos"]))


def confident(snps: Column, least: float = 0.9) -> Column:
    """Sites that are heterozygous with more than least."""
    return F.filter(snps, lambda s: s["het_prob"] > least)


def region_totals(rows: DataFrame, by: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """as_ref, as_alt, as_total and all_reads of each region over individuals."""
    total = lambda f: F.sum(F.aggregate(confident(F.col("region_snps")), F.lit(0).cast("long"), lambda s, x: s + x[f]))
    return rows.groupBy(*by).agg(total("ref_n").alias("as_ref"), total("alt_n").alias("as_alt"), F.sum("region_reads").alias("all_reads")).withColumn("as_total", F.col("as_ref") + F.col("as_alt"))


def rescaled(rows: DataFrame, total: str = "genome_reads", by: str = "region_id") -> DataFrame:
    """rows with the total divided by its least value within the region, if that is over 0."""
    least = F.min(total).over(Window.partitionBy(by))
    return rows.withColumn("scale", F.when(least > 0, F.col(total) / least).otherwise(F.col(total)))


def _posterior(prior: np.ndarray, ref: np.ndarray, alt: np.ndarray, error: float) -> np.ndarray:
    """likelihood.het_posterior() of arrays."""
    prior = np.fmin(prior, 0.99)
    wrong, right = math.log(error), math.log(1 - error)
    d = math.log(0.5) * (ref + alt) - np.logaddexp(wrong * ref + right * alt, right * ref + wrong * alt)
    with np.errstate(all="ignore"):
        odds = prior * np.exp(np.minimum(d, 40))
        return np.where(d > 40, 1.0, odds / (odds + 1 - prior))


def update_het_probs(rows: DataFrame, as_counts: DataFrame, error: float = 0.01, key: tuple[str, ...] = ("region_id", "individual")) -> DataFrame:
    """rows whose sites have posterior heterozygote probabilities, given counts (chrom, site, individual, ref_n, alt_n)."""
    home = F.floor(F.col("region_snps")[0]["pos"] / BIN)
    sited = rows.where("size(region_snps) > 0").withColumn("_home", home)
    needs = sited.select("chrom", F.col("_home").alias("_to"), F.explode(F.array_distinct(F.transform("region_snps", lambda s: F.floor(s["pos"] / BIN)))).alias("_bin")).distinct()
    n = as_counts.select("chrom", "individual", F.col("site").cast("long").alias("pos"), F.col("ref_n").cast("double").alias("r"), F.col("alt_n").cast("double").alias("a"), F.floor(F.col("site") / BIN).alias("_bin"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = n.join(needs, ["chrom", "_bin"]).drop("_bin").repartition(parts, "chrom", "_to")

    def updated(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns(["_home"])
        if not left.num_rows:
            return left
        codes = pa.chunked_array([*left.column("individual").chunks, *right.column("individual").chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        whole = left.column("region_snps").combine_chunks()
        sizes, sites = _lists(left.column("region_snps"))
        fields = [sites.field(i) for i in range(sites.type.num_fields)]
        names = [f.name for f in sites.type]
        pos, prior = (_whole(pa.chunked_array([fields[names.index(c)]]), none) for c, none in (("pos", 0), ("het_prob", 0.99)))
        there = _whole(right.column("pos"))
        span = int(max(pos.max(initial=0), there.max(initial=0))) + 1
        key = codes[left.num_rows :] * span + there
        order = np.argsort(key)
        key = np.append(key[order], -1)
        own = np.repeat(codes[: left.num_rows], sizes) * span + pos
        k = np.searchsorted(key[:-1], own)
        hit = key[k] == own
        r, a = (np.where(hit, np.append(_whole(right.column(c))[order], 0.0)[k], 0.0) for c in ("r", "a"))
        fields[names.index("het_prob")] = pa.array(_posterior(prior, r, a, error))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names), mask=whole.is_null())
        return left.set_column(left.column_names.index("region_snps"), "region_snps", lists)

    schema = rows.schema
    some = sited.repartition(parts, "chrom", "_home").groupBy("chrom", "_home").cogroup(near.groupBy("chrom", "_to")).applyInArrow(updated, schema)
    return some.unionByName(rows.where("coalesce(size(region_snps), 0) <= 0"))


def permuted(rows: DataFrame, seed: int = 0) -> DataFrame:
    """rows with genotypes and haplotypes dealt out anew among the individuals of a region, and the
    alleles of each site turned about by a coin; all by hash, so the same for any partitioning."""
    moved = ["genotype", "haplotype"]
    rest = [c for c in rows.columns if c not in ("region_id", *moved)]
    own = F.struct("individual", F.struct(*(c for c in rest if c != "individual")).alias("_row"))
    dealt = F.struct(hash_order("region_id", "individual", seed=seed).alias("_h"), "individual", *moved)
    both = rows.groupBy("region_id").agg(F.sort_array(F.collect_list(dealt)).alias("_there"), F.array_sort(F.collect_list(own), lambda x, y: F.when(x["individual"] < y["individual"], -1).when(x["individual"] > y["individual"], 1).otherwise(0)).alias("_here"))
    each = both.select("region_id", "_there", F.posexplode("_here").alias("_n", "_own")).select("region_id", "_own.individual", "_own._row.*", F.get("_there", F.col("_n")).alias("_t"))
    each = each.select(*(F.col(f"_t.{c}").alias(c) if c in moved else F.col(c) for c in rows.columns))
    flip = lambda s: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("region_id").cast("string"), F.col("individual").cast("string"), s["pos"].cast("string"), F.lit(str(seed)))), 1, 1), 16, 10).cast("int") % 2 == 1
    turned = F.transform("region_snps", lambda s: F.when(flip(s), s.withField("ref_n", s["alt_n"]).withField("alt_n", s["ref_n"])).otherwise(s))
    return each.withColumn("region_snps", turned)
