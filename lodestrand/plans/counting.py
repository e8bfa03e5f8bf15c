"""Queries by individual, in the dialect of counting, and with uncertain genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, coords, likelihood
from ..operators import association, classify, counts, haplotypes, overlap, regions, remap, simulate
from ..sources import chrom as chroms
from . import views
from .queries import AS_COUNTS, BASE, COUNTS, DUPLICATE, INPUT_BASE, PAIRS, PARTS, as_counts, input_rows, query, two_part_regions, usable
from .views import BLOCKS, GENOTYPES, READS, SEQUENCE, SNPS, h, hashed, load, with_sql

# -- by individual


@query(with_sql(READS, body="SELECT qname, individual, chrom, pos, flag FROM reads WHERE flag IN (0, 16) QUALIFY row_number() OVER (PARTITION BY individual, chrom, pos, flag ORDER BY md5(qname || '|0'), qname) = 1"))
def rmdup_by_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read of each individual, position and strand."""
    return remap.dedup_single(views.reads(spark, sf_dir), by=("individual",)).select("qname", "individual", "chrom", "pos", "flag")


OWNED = f"u AS (SELECT *, (qname % 3)::BIGINT AS individual FROM pairs WHERE {DUPLICATE} = 'paired')"


@query(with_sql(PAIRS, OWNED, "names AS (SELECT individual, chrom, qname, least(pos, mate_pos) AS lo, greatest(pos, mate_pos) AS hi FROM u GROUP BY ALL HAVING count(*) = 2)", "chosen AS (SELECT individual, chrom, qname FROM names QUALIFY row_number() OVER (PARTITION BY individual, chrom, lo, hi ORDER BY md5(qname::VARCHAR || '|0'), qname) = 1)", body="SELECT u.qname, u.individual, u.mate, u.chrom, u.pos FROM u JOIN chosen USING (individual, chrom, qname)"))
def rmdup_pairs_by_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair of each individual and two positions."""
    owned = views.pairs(spark, sf_dir).withColumn("individual", (F.col("qname") % 3).cast("long"))
    return remap.dedup_pairs(owned, by=("individual",)).select("qname", "individual", "mate", "chrom", "pos")


# -- verdicts on pairs that were aligned again


def remapped_mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs to align again (both reads of each), and what came back: two versions of each, most as proper pairs where they were."""
    both = views.pairs(spark, sf_dir).where("mate = 0 AND chrom = mate_chrom").select("qname", "chrom", F.least("pos", "mate_pos").alias("a"), F.greatest("pos", "mate_pos").alias("b"))
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("right")
    to_remap = both.select(F.col("qname").cast("string").alias("qname"), "chrom", "a", "b", side).select("qname", "chrom", F.when(F.col("right") == 1, F.col("b")).otherwise(F.col("a")).alias("pos"), F.lit("32M").alias("cigar"))
    each = both.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("kind", hashed("m", F.concat_ws("-", F.col("qname").cast("string"), F.col("v").cast("string"))) % 14)
    each = each.where("kind <> 0").select("*", side)
    kind, right = F.col("kind"), F.col("right") == 1
    flag = F.when(kind == 1, 0).when(kind == 2, 1).otherwise(3) + F.when((kind == 3) & right, 256).otherwise(0) + F.when(right, 128).otherwise(64)
    shift = F.when(kind == 4, 1).when((kind == 5) & right, 1).otherwise(0)
    mate_shift = F.when(kind == 4, 1).when((kind == 5) & ~right, 1).otherwise(0)
    swapped = kind == 6  # the first read lies to the right
    own, other = F.when(right, F.col("b")).otherwise(F.col("a")), F.when(right, F.col("a")).otherwise(F.col("b"))
    back = each.where("NOT (kind = 7 AND right = 0)").select(
        alleles.encode_name(F.col("qname").cast("string"), [F.when(swapped, F.col("b")).otherwise(F.col("a")), F.when(swapped, F.col("a")).otherwise(F.col("b"))], F.col("v"), F.lit(2)).alias("name"),
        flag.cast("int").alias("flag"), "chrom", (own + shift).alias("pos"), (other + mate_shift).alias("mate_pos"), F.when((kind == 8) & right, F.lit("31M1S")).otherwise(F.lit("32M")).alias("cigar"))
    return to_remap, back


_MKEY = "(qname || '-' || v::VARCHAR)"
MATES = f"""both_ AS (SELECT qname::VARCHAR AS qname, chrom, least(pos, mate_pos) AS a, greatest(pos, mate_pos) AS b FROM pairs WHERE mate = 0 AND chrom = mate_chrom),
each_ AS (SELECT *, {h("m", _MKEY)} % 14 AS kind FROM both_, (VALUES (1), (2)) AS t(v), (VALUES (0), (1)) AS s("right")),
back AS (SELECT qname, CASE WHEN kind = 6 THEN b ELSE a END AS exp1, CASE WHEN kind = 6 THEN a ELSE b END AS exp2,
  CASE WHEN "right" = 1 THEN b ELSE a END + CASE WHEN kind = 4 OR (kind = 5 AND "right" = 1) THEN 1 ELSE 0 END AS pos, CASE WHEN "right" = 1 THEN a ELSE b END + CASE WHEN kind = 4 OR (kind = 5 AND "right" = 0) THEN 1 ELSE 0 END AS mate_pos,
  kind IN (1, 2) OR (kind = 3 AND "right" = 1) AS bad, "right" = 0 AS is_first, CASE WHEN kind = 8 AND "right" = 1 THEN '31M1S' ELSE '32M' END AS cigar
  FROM each_ WHERE kind <> 0 AND NOT (kind = 7 AND "right" = 0)),
told AS (SELECT *, pos < mate_pos OR (pos = mate_pos AND is_first) AS tells, pos = exp1 AND mate_pos = exp2 AS fine FROM back),
tally AS (SELECT qname, bool_or(bad) AS poisoned, count(*) FILTER (WHERE tells AND fine) AS n_right, count(*) FILTER (WHERE tells AND NOT fine) AS n_wrong, bool_and(cigar = '32M') AS same FROM told GROUP BY qname)"""


@query(with_sql(PAIRS, MATES, body="SELECT b.qname, CASE WHEN t.qname IS NULL THEN 'missing' WHEN poisoned THEN 'poisoned' WHEN n_wrong > 0 THEN 'wrong_place' WHEN n_right <> 2 THEN 'incomplete' WHEN NOT same THEN 'cigar_changed' ELSE 'keep' END AS verdict FROM both_ b LEFT JOIN tally t USING (qname)"))
def remap_verdict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided on each pair whose versions were aligned again."""
    return remap.remap_verdict(*remapped_mates(spark, sf_dir)).select("qname", "verdict").distinct()


# -- the dialect of counting: no clipped reads, none past the end or over an indel, heterozygous sites alone

#: A length that some reads reach past.
SHORT = views.SPACE - 20
COUNTABLE = f"""spans AS (SELECT qname, sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) AS span FROM ops GROUP BY qname),
countable AS (SELECT r.* FROM reads r JOIN spans s USING (qname) WHERE r.flag IN (0, 16) AND r.pos + s.span - 1 <= {SHORT} AND r.cigar NOT LIKE '%S%'),
chits AS (SELECT b.qname, b.individual, b.chrom, s.pos, s.allele1, s.allele2, length(s.allele1) <> 1 OR length(s.allele2) <> 1 AS changes, substr(b.seq, (b.r_start + s.pos - b.g_start)::INTEGER, 1) AS base
  FROM blocks b JOIN countable c ON c.qname = b.qname JOIN snps s ON s.chrom = b.chrom AND s.pos BETWEEN b.g_start AND b.g_start + b.n - 1 WHERE b.op = 'M'),
over_indel AS (SELECT DISTINCT qname FROM chits WHERE changes)"""


def counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    short = views.chromosomes(spark).withColumn("length", F.lit(SHORT).cast("long"))
    return counts.count_reads(usable(views.reads(spark, sf_dir)), views.snps(spark, sf_dir), short, views.genotypes(spark, sf_dir))


@query(with_sql(*BASE, COUNTABLE, body="SELECT individual, chrom, pos, count(*) AS n FROM countable WHERE qname NOT IN (SELECT qname FROM over_indel) GROUP BY ALL"))
def depth_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each individual as counting makes it."""
    return counted(spark, sf_dir)[0]


@query(with_sql(*BASE, GENOTYPES, COUNTABLE, "free AS (SELECT c.* FROM chits c JOIN genotypes g ON g.chrom = c.chrom AND g.pos = c.pos AND g.individual = c.individual AND g.hap1 <> g.hap2 WHERE c.qname NOT IN (SELECT qname FROM over_indel))", "one AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY individual, qname ORDER BY md5(qname || '|' || pos::VARCHAR || '|0')) = 1)", body=f"SELECT individual, chrom, pos AS site, allele1 AS ref, allele2 AS alt, {COUNTS} FROM one GROUP BY ALL"))
def as_counts_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele counts of each individual as counting makes them."""
    return counted(spark, sf_dir)[1]


# -- uncertain genotypes

_PKEY = "(snp_idx::VARCHAR || '-' || individual::VARCHAR)"
UNSURE = f"""unsure AS MATERIALIZED (SELECT chrom, pos, individual, {h("t", _PKEY)} % 1000 / 1000.0 AS p_ra, (1 - {h("t", _PKEY)} % 1000 / 1000.0) * ({h("o", _PKEY)} % 100) / 100.0 AS p_aa FROM genotypes)"""


def unsure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each individual has each genotype: chrom, pos, individual, p_ra, p_aa."""
    key = F.concat_ws("-", F.col("snp_idx").cast("string"), F.col("individual").cast("string"))
    het = hashed("t", key) % 1000 / 1000.0
    return views.genotypes(spark, sf_dir).select("chrom", "pos", "individual", het.alias("p_ra"), ((1 - het) * (hashed("o", key) % 100) / 100.0).alias("p_aa"))


SITES_OF = "sites AS MATERIALIZED (SELECT DISTINCT p.region_id, p.chrom, p.test_pos, s.pos FROM parts p JOIN snps s ON s.chrom = p.chrom AND s.pos BETWEEN p.a AND p.z)"


@query(with_sql(*BASE, GENOTYPES, PARTS, UNSURE, SITES_OF, body="""SELECT g.chrom || ':' || g.pos::VARCHAR AS region_id, g.individual, round(g.p_ra + 2 * g.p_aa, 6) AS genotype, x.n_sites, round(x.het_probs, 6) AS het_probs
FROM unsure g LEFT JOIN (SELECT s.region_id, t.individual, count(*) AS n_sites, sum(u.p_ra) AS het_probs FROM sites s JOIN genotypes t ON t.chrom = s.chrom AND t.pos = s.pos AND t.hap1 <> t.hap2 JOIN unsure u ON u.chrom = t.chrom AND u.pos = t.pos AND u.individual = t.individual GROUP BY ALL) x ON x.region_id = g.chrom || ':' || g.pos::VARCHAR AND x.individual = g.individual"""))
def cht_input_het_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the combined test from genotype probabilities: expected dose, and the sum of the sites' chances of being heterozygous."""
    p = unsure(spark, sf_dir)
    sites = haplotypes.region_lists(two_part_regions(spark, sf_dir), views.genotypes(spark, sf_dir), as_counts(spark, sf_dir), probabilities=p).where("region_snps IS NOT NULL")
    total = F.aggregate("region_snps", F.lit(0.0), lambda t, s: t + s["het_prob"])
    listed = sites.select("region_id", "individual", F.size("region_snps").cast("long").alias("n_sites"), F.round(total, 6).alias("het_probs"))
    rows = p.select(F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("region_id"), "individual", F.round(haplotypes.dosage(F.col("p_ra"), F.col("p_aa")), 6).alias("genotype"))
    return rows.join(listed, ["region_id", "individual"], "left")


_GOOD = "ln(0.5) * (ref_n + alt_n)"
_X, _Y = "(ln(0.01) * ref_n + ln(0.99) * alt_n)", "(ln(0.99) * ref_n + ln(0.01) * alt_n)"
_DIFF = f"({_GOOD} - (greatest({_X}, {_Y}) + ln(1 + exp(-abs({_X} - {_Y})))))"


@query(with_sql(*BASE, GENOTYPES, AS_COUNTS, PARTS, SITES_OF, body=f"""SELECT region_id, individual, count(*) AS n_sites, round(sum(CASE WHEN d > 40 THEN 1.0 ELSE 0.99 * exp(d) / (0.99 * exp(d) + 0.01) END), 5) AS het_probs FROM (
  SELECT region_id, individual, {_DIFF} AS d FROM (SELECT s.region_id, g.individual, coalesce(c.ref_n, 0) AS ref_n, coalesce(c.alt_n, 0) AS alt_n FROM sites s JOIN genotypes g ON g.chrom = s.chrom AND g.pos = s.pos AND g.hap1 <> g.hap2 LEFT JOIN as_counts c ON c.chrom = s.chrom AND c.site = s.pos AND c.individual = g.individual) AS y) AS x GROUP BY ALL"""))
def het_probs_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of being heterozygous after the counts are known, summed over the sites of each row."""
    rows = haplotypes.update_het_probs(input_rows(spark, sf_dir).where("region_snps IS NOT NULL"), as_counts(spark, sf_dir))
    total = F.aggregate("region_snps", F.lit(0.0), lambda s, x: s + x["het_prob"])
    return rows.select("region_id", "individual", F.size("region_snps").cast("long").alias("n_sites"), F.round(total, 5).alias("het_probs"))


# -- rows, regions and coordinates

ORIENTED = f"""{SITES_OF},
placed AS (SELECT s.*, g.individual, g.hap1, g.hap2, CASE WHEN t.hap1 <> t.hap2 THEN t.hap1 END AS test_hap1, coalesce(c.ref_n, 0) AS r, coalesce(c.alt_n, 0) AS a
  FROM sites s JOIN genotypes g ON g.chrom = s.chrom AND g.pos = s.pos AND g.hap1 <> g.hap2 LEFT JOIN genotypes t ON t.chrom = s.chrom AND t.pos = s.test_pos AND t.individual = g.individual LEFT JOIN as_counts c ON c.chrom = s.chrom AND c.site = s.pos AND c.individual = g.individual),
turned AS (SELECT region_id, individual, CASE WHEN test_hap1 IS NULL THEN 0 WHEN CASE WHEN test_hap1 = 0 THEN hap1 = 0 ELSE hap2 = 0 END THEN r ELSE a END AS ref_n, CASE WHEN test_hap1 IS NULL THEN 0 WHEN CASE WHEN test_hap1 = 0 THEN hap1 = 0 ELSE hap2 = 0 END THEN a ELSE r END AS alt_n FROM placed),
alleles AS (SELECT region_id, sum(ref_n)::BIGINT AS as_ref, sum(alt_n)::BIGINT AS as_alt FROM turned GROUP BY ALL),
depths AS (SELECT g.chrom || ':' || g.pos::VARCHAR AS region_id, sum(coalesce(r.region_reads, 0))::BIGINT AS all_reads FROM genotypes g LEFT JOIN rdepth r ON r.region_id = g.chrom || ':' || g.pos::VARCHAR AND r.individual = g.individual GROUP BY ALL)"""


@query(with_sql(*INPUT_BASE, ORIENTED, body="SELECT d.region_id, as_ref, as_alt, all_reads, as_ref + as_alt AS as_total FROM depths d LEFT JOIN alleles a USING (region_id)"))
def region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles and reads of each region over individuals."""
    return haplotypes.region_totals(input_rows(spark, sf_dir))


@query(with_sql(*INPUT_BASE, SEQUENCE, "gc AS (SELECT region_id, sum(length(c) - length(translate(c, 'GC', ''))) * 1.0 / sum(length(c)) AS gc FROM (SELECT region_id, substr(g.bases, (greatest(p.a - g.chunk_start, 0) + 1)::INTEGER, (least(p.z - g.chunk_start, 31) - greatest(p.a - g.chunk_start, 0) + 1)::INTEGER) AS c FROM parts p JOIN genome g ON g.chrom = p.chrom AND g.chunk_start BETWEEN p.a - 31 AND p.z) AS x GROUP BY region_id)", "wide AS (SELECT g.chrom || ':' || g.pos::VARCHAR AS region_id, g.individual, coalesce(r.region_reads, 0) AS n FROM genotypes g LEFT JOIN rdepth r ON r.region_id = g.chrom || ':' || g.pos::VARCHAR AND r.individual = g.individual)", body="SELECT region_id, round(any_value(gc.gc), 6) AS gc, sum(n)::BIGINT AS total, " + ", ".join(f'max(n) FILTER (WHERE individual = {i}) AS "{i}"' for i in range(25)) + " FROM wide JOIN gc USING (region_id) GROUP BY region_id HAVING sum(n) >= 5"))
def depth_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GC, total and each individual's reads of the regions with five reads or more."""
    rows = input_rows(spark, sf_dir)
    wide = association.count_matrix(rows, "region_reads", list(range(25)))
    gc = regions.region_bases(two_part_regions(spark, sf_dir), views.sequence(spark, sf_dir)).select("region_id", F.round("gc_fraction", 6).alias("gc"))
    total = rows.groupBy("region_id").agg(F.sum("region_reads").alias("total")).where("total >= 5")
    return wide.join(gc, "region_id").join(total, "region_id")


@query(with_sql(SNPS, "r AS (SELECT chrom || ':' || pos::VARCHAR AS region_id, pos, row_number() OVER (ORDER BY pos, chrom || ':' || pos::VARCHAR) - 1 AS i FROM snps)", body="SELECT region_id, pos FROM r WHERE i % 4 = 3"))
def rows_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that are left when three are passed over before each."""
    rows = views.snps(spark, sf_dir).select(F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("region_id"), "pos")
    return association.every_other(rows, 3, "pos")


@query(with_sql(READS, body="SELECT qname, substr(chrom, 4)::INTEGER AS idnum, CASE WHEN flag & 16 <> 0 THEN -1 ELSE 1 END AS strand, pos AS start, row_number() OVER (PARTITION BY chrom ORDER BY CASE WHEN flag & 16 <> 0 THEN -1 ELSE 1 END, pos, qname) AS place FROM reads"))
def coord_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads are sorted by, and their place in that order on their chromosome."""
    from pyspark.sql import Window

    ids = F.broadcast(chroms.numbered(views.chromosomes(spark)).select("chrom", "idnum"))  # a row per chromosome
    r = views.reads(spark, sf_dir).join(ids, "chrom").withColumn("k", coords.key(F.col("idnum"), F.col("pos"), F.when(classify.has(classify.REVERSE), -1).otherwise(1)))
    return r.select("qname", "k.*", F.row_number().over(Window.partitionBy("chrom").orderBy("k", "qname")).cast("long").alias("place"))


@query(with_sql(SNPS, body="SELECT chrom, pos, greatest(mid - 150, 1) AS start, least(greatest(mid - 150, 1) + 299, 21000) AS stop, mid BETWEEN 1 AND 21000 AS ok, greatest(pos - 60, 1) AS wide_start, least(pos + 60, 21000) AS wide_stop FROM (SELECT chrom, pos, (greatest(pos - 50, 1) + pos + 150) // 2 AS mid FROM snps) AS x"))
def coord_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of two parts made one of a fixed size, and intervals widened."""
    r = two_part_regions(spark, sf_dir)
    length = F.lit(21_000)
    start, stop = coords.resized(F.col("starts"), F.col("stops"), 300, length)
    wide = coords.expanded(F.col("test_pos") - 50, F.col("test_pos") + 50, 10, length)
    return r.select("chrom", F.col("test_pos").alias("pos"), start.alias("start"), stop.alias("stop"), coords.valid(start, stop).alias("ok"), wide["start"].cast("long").alias("wide_start"), wide["stop"].cast("long").alias("wide_stop"))


@query("SELECT p_partkey, round(1 + 0.5 * p_size / 50.0 - 0.25 * p_retailprice / 1000.0, 6) AS factor FROM part")
def covariate_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of two covariates."""
    c = F.array(F.lit(0.5), F.lit(-0.25))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(likelihood.covariate_factor(c, F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0)), 6).alias("factor"))


@query(with_sql(SNPS, GENOTYPES, SEQUENCE, body="""SELECT g.chrom, g.chunk_start, t.hap, coalesce(sum(CASE WHEN substr(g.bases, (s.pos - g.chunk_start + 1)::INTEGER, 1) <> s.allele2 THEN 1 END), 0)::BIGINT AS changed FROM genome g CROSS JOIN (VALUES (1), (2)) AS t(hap)
LEFT JOIN (SELECT s.chrom, s.pos, s.allele2, x.hap1, x.hap2 FROM snps s JOIN genotypes x ON x.chrom = s.chrom AND x.pos = s.pos AND x.individual = 0 WHERE length(s.allele2) = 1) s ON s.chrom = g.chrom AND s.pos BETWEEN g.chunk_start AND g.chunk_start + 31 AND CASE WHEN t.hap = 1 THEN s.hap1 ELSE s.hap2 END = 1 GROUP BY ALL"""))
def haplotype_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bases of each chunk the first individual's two copies have of their own."""
    haps = views.snps(spark, sf_dir).where("length(allele2) = 1").join(views.genotypes(spark, sf_dir).where("individual = 0").select("chrom", "pos", "hap1", "hap2"), ["chrom", "pos"]).select("chrom", "pos", F.col("allele1").alias("ref"), F.col("allele2").alias("alt"), "hap1", "hap2")
    copies = simulate.haplotype_chunks(views.sequence(spark, sf_dir), haps, chunk=32)
    both = copies.join(views.sequence(spark, sf_dir).withColumnRenamed("bases", "own"), ["chrom", "chunk_start"])
    differ = F.size(F.filter(F.sequence(F.lit(1), F.length("own")), lambda i: F.substr("own", i, F.lit(1)) != F.substr("bases", i, F.lit(1))))
    return both.select("chrom", "chunk_start", "hap", differ.cast("long").alias("changed"))
