"""Queries of the library over the derived tables, each with SQL of the same meaning where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, cigar, coords, likelihood, seq
from ..operators import association, classify, counts, haplotypes, overlap, regions, remap, simulate, split
from ..sources import chrom as chroms
from ..sources import impute, tables, vcf
from ..sources.scratch import folder
from . import views
from .views import BLOCKS, GENOTYPES, PAIRS, READS, SEQUENCE, SNPS, h, hashed, load, with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HALF = 100


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def usable(reads: DataFrame) -> DataFrame:
    return reads.withColumn("disposition", classify.mapping_disposition()).where("disposition = 'single'").drop("disposition")


USABLE = "b.flag IN (0, 16)"
SIMPLE = "regexp_matches(allele1, '^[ACGT]$') AND regexp_matches(allele2, '^[ACGT]$')"
COUNTS = "count(*) FILTER (WHERE base = allele1) AS ref_n, count(*) FILTER (WHERE base = allele2 AND base <> allele1) AS alt_n, count(*) FILTER (WHERE base <> allele1 AND base <> allele2) AS other_n"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.read_variants(usable(views.reads(spark, sf_dir)), views.snps(spark, sf_dir))


def as_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each individual."""
    return counts.allele_counts(hits(spark, sf_dir), ("individual", "chrom", "site", "ref", "alt"))


AS_COUNTS = f"""as_counts AS (
  SELECT individual, chrom, pos AS site, allele1 AS ref, allele2 AS alt, {COUNTS} FROM hits b WHERE is_snp AND {USABLE} GROUP BY ALL)"""
BASE = (READS, SNPS, BLOCKS)


@query(with_sql(*BASE, body=f"SELECT chrom, pos AS site, allele1 AS ref, allele2 AS alt, {COUNTS} FROM hits b WHERE is_snp AND {USABLE} GROUP BY ALL"))
def ase_snp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele counts at every SNP over all usable reads."""
    return counts.allele_counts(hits(spark, sf_dir))


@query(with_sql(*BASE, body=f"SELECT qname, pos AS site, snp_idx, read_pos, is_snp, base FROM hits b WHERE op <> 'D' AND {USABLE}"))
def overlap_multiblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant in every aligned block of every read."""
    return hits(spark, sf_dir).where("base IS NOT NULL").select("qname", "site", "snp_idx", "read_pos", "is_snp", "base")


@query(with_sql(*BASE, body=f"SELECT qname, count(*) FILTER (WHERE is_snp) AS n_snps, count(*) FILTER (WHERE NOT is_snp) AS n_indels, bool_or(NOT is_snp) AS discarded FROM hits b WHERE {USABLE} GROUP BY qname"))
def overlap_indel_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with SNPs and indels that they cover; an indel discards a read."""
    return hits(spark, sf_dir).groupBy("qname").agg(F.count_if("is_snp").alias("n_snps"), F.count_if(~F.col("is_snp")).alias("n_indels"), F.bool_or(~F.col("is_snp")).alias("discarded"))


DISPOSITION = """CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 256 <> 0 THEN 'secondary' WHEN flag & 2048 <> 0 THEN 'supplementary' WHEN flag & 1 = 0 THEN 'single'
  WHEN flag & 8 <> 0 THEN 'mate_unmapped' WHEN chrom <> mate_chrom THEN 'different_chromosome' WHEN flag & 2 = 0 THEN 'improper_pair' ELSE 'paired' END"""
DUPLICATE = """CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 8 <> 0 THEN 'mate_unmapped' WHEN flag & 256 <> 0 THEN 'secondary' WHEN flag & 1 = 0 THEN 'not_paired'
  WHEN chrom <> mate_chrom THEN 'different_chromosome' WHEN flag & 2 = 0 THEN 'improper_pair' ELSE 'paired' END"""


@query(with_sql(PAIRS, body=f"SELECT {DISPOSITION} AS disposition, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM pairs GROUP BY 1"))
def read_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired reads by what becomes of them before the variant join."""
    rows = views.pairs(spark, sf_dir).withColumn("disposition", classify.mapping_disposition(F.col("chrom") == F.col("mate_chrom")))
    return classify.report(rows).withColumn("share", F.round("share", 6))


@query(with_sql(PAIRS, body=f"SELECT {DUPLICATE} AS disposition, count(*) AS n FROM pairs GROUP BY 1"))
def rmdup_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired reads by what becomes of them before duplicates go."""
    rows = views.pairs(spark, sf_dir).withColumn("disposition", classify.duplicate_disposition(F.col("chrom") == F.col("mate_chrom")))
    return rows.groupBy("disposition").agg(F.count("*").alias("n"))


@query(with_sql(*BASE, body=f"SELECT ref_n, alt_n, other_n, round(other_n * 1.0 / (ref_n + alt_n + other_n), 6) AS other_share FROM (SELECT {COUNTS} FROM hits b WHERE is_snp AND {USABLE}) AS x"))
def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all bases at SNPs."""
    return counts.match_totals(hits(spark, sf_dir)).withColumn("other_share", F.round("other_share", 6))


@query(with_sql(READS, body="SELECT chrom, count(*) AS n, count(*) FILTER (WHERE mapq >= 10) AS mapped_well FROM reads WHERE flag & 4 = 0 GROUP BY chrom"))
def mapq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped reads, and those of quality 10 or more, by chromosome."""
    r = views.reads(spark, sf_dir).where(~classify.has(classify.UNMAPPED))
    return r.groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(F.col("mapq") >= 10).alias("mapped_well"))


CIGAR_LENGTHS = "sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END)::BIGINT AS read_bases, sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END)::BIGINT AS ref_bases, sum(CASE WHEN op IN ('M','=','X') THEN n ELSE 0 END)::BIGINT AS aligned_bases"


@query(with_sql(*BASE, body=f"SELECT qname, cigar, {CIGAR_LENGTHS} FROM ops GROUP BY qname, cigar"))
def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, reference and aligned bases of each read's CIGAR."""
    c = F.col("cigar")
    return views.reads(spark, sf_dir).select("qname", "cigar", cigar.read_length(c).alias("read_bases"), cigar.reference_length(c).alias("ref_bases"), cigar.aligned_length(c).alias("aligned_bases"))


@query(with_sql(SNPS, body=f"SELECT chrom, pos, allele1, allele2, {SIMPLE} AS is_snp, length(allele1) <> 1 OR length(allele2) <> 1 AS changes_length FROM snps"))
def variant_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by kind, the last at each position."""
    a = F.col("allele1"), F.col("allele2")
    return views.snps(spark, sf_dir).select("chrom", "pos", "allele1", "allele2", alleles.is_snp(*a).alias("is_snp"), alleles.is_length_changing(*a).alias("changes_length"))


@query(with_sql(SNPS, GENOTYPES, body="""SELECT chrom, pos, sum((hap1 IS NOT NULL)::INT + (hap2 IS NOT NULL)::INT - coalesce(hap1, 0) - coalesce(hap2, 0))::BIGINT AS ref_n, sum(coalesce(hap1, 0) + coalesce(hap2, 0))::BIGINT AS alt_n
FROM genotypes GROUP BY chrom, pos HAVING ref_n > 0 AND alt_n > 0"""))
def polymorphic_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants at which the samples have both alleles."""
    return counts.polymorphic(views.genotypes(spark, sf_dir))


@query(with_sql(SNPS, GENOTYPES, body="SELECT chrom, pos, hom_ref, het, hom_alt, least(2 * hom_ref + het, 2 * hom_alt + het) AS minor_n FROM (SELECT chrom, pos, count(*) FILTER (WHERE hap1 + hap2 = 0) AS hom_ref, count(*) FILTER (WHERE hap1 + hap2 = 1) AS het, count(*) FILTER (WHERE hap1 + hap2 = 2) AS hom_alt FROM genotypes GROUP BY chrom, pos) AS x"))
def genotype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes and minor allele counts."""
    return counts.genotype_counts(views.genotypes(spark, sf_dir))


@query(with_sql(SNPS, GENOTYPES, body="SELECT sample, count(*) AS n, count(*) FILTER (WHERE hap1 <> hap2) AS het FROM genotypes WHERE sample IN ((SELECT min(n_name) FROM nation), (SELECT max(n_name) FROM nation)) GROUP BY sample"))
def sample_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of the first and last sample by name."""
    n = load(spark, sf_dir, "nation").agg(F.min("n_name"), F.max("n_name")).first()
    g = counts.subset_samples(views.genotypes(spark, sf_dir), [n[0], n[1], n[0]])
    return g.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(F.col("hap1") != F.col("hap2")).alias("het"))


FEW = f"few AS (SELECT qname FROM hits b WHERE {USABLE} GROUP BY qname HAVING bool_and(is_snp) AND count(*) BETWEEN 1 AND 6)"
SITES = f"sites AS (SELECT b.qname, seq, chrom, pos, read_pos, allele1, allele2, row_number() OVER (PARTITION BY b.qname ORDER BY read_pos, pos) AS k FROM hits b JOIN few USING (qname) WHERE {USABLE})"
ALL_VERSIONS = """versions AS (
  SELECT qname, seq AS own, seq, 1 AS k FROM sites WHERE k = 1
  UNION
  SELECT v.qname, v.own, left(v.seq, (s.read_pos - 1)::INTEGER) || a.allele || substr(v.seq, (s.read_pos + 1)::INTEGER) AS seq, v.k + 1
  FROM versions v JOIN sites s ON s.qname = v.qname AND s.k = v.k, unnest([substr(v.seq, s.read_pos::INTEGER, 1), s.allele1, s.allele2]) AS a(allele)),
made AS (SELECT DISTINCT v.qname, v.seq FROM versions v JOIN (SELECT qname, max(k) + 1 AS last FROM sites GROUP BY qname) l ON l.qname = v.qname AND v.k = l.last WHERE v.seq <> v.own)"""


@query(with_sql(*BASE, FEW, SITES, ALL_VERSIONS, body="SELECT m.qname, r.pos, row_number() OVER (PARTITION BY m.qname ORDER BY m.seq) AS version_no, count(*) OVER (PARTITION BY m.qname) AS n_versions, m.seq FROM made m JOIN reads r USING (qname) QUALIFY count(*) OVER (PARTITION BY m.qname) < 64").replace("WITH ", "WITH RECURSIVE ", 1))
def versions_all_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of reads with every allele of the sites that they cover."""
    _, v = split.split_single(views.reads(spark, sf_dir), views.snps(spark, sf_dir))
    return v.select("qname", "pos", F.col("version_no").cast("long").alias("version_no"), F.col("n_versions").cast("long").alias("n_versions"), "seq")


@query(with_sql(*BASE, FEW, SITES, ALL_VERSIONS, """state AS (SELECT qname, count(*) FILTER (WHERE is_snp) AS n_snps, count(*) FILTER (WHERE NOT is_snp) AS n_indels FROM hits GROUP BY qname), n AS (SELECT qname, count(*) AS n FROM made GROUP BY qname)""", body="""SELECT CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 256 <> 0 THEN 'secondary' WHEN flag & 2048 <> 0 THEN 'supplementary' WHEN n_indels > 0 THEN 'indel' WHEN n_snps > 6 THEN 'excess_snps' WHEN n.n IS NULL THEN 'keep' WHEN n.n < 64 THEN 'remap' ELSE 'excess_versions' END AS disposition, count(*) AS n
FROM reads LEFT JOIN state USING (qname) LEFT JOIN n USING (qname) GROUP BY 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def split_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reads by what becomes of them after the variant join."""
    rows, _ = split.split_single(views.reads(spark, sf_dir), views.snps(spark, sf_dir))
    return rows.groupBy("disposition").agg(F.count("*").alias("n"))


def _haplotype_sql(phased: str) -> str:
    """Versions by haplotypes: two starts for each sample, branching at unphased heterozygotes."""
    parts = """placed AS (SELECT s.qname, s.seq, s.read_pos, s.allele1, s.allele2, s.k, g.sample, g.hap1, g.hap2, {phased} AS phased FROM sites s JOIN genotypes g ON g.chrom = s.chrom AND g.pos = s.pos),
whole AS (SELECT qname, sample, max(k) AS last, bool_and(hap1 IS NOT NULL) AS ok1, bool_and(hap2 IS NOT NULL) AS ok2 FROM placed GROUP BY qname, sample),
grown AS (
  SELECT a.qname, a.sample, w.side, a.seq AS own, a.seq, 1 AS k FROM (SELECT DISTINCT qname, sample, seq FROM placed) a JOIN (SELECT qname, sample, 1 AS side FROM whole WHERE ok1 UNION ALL SELECT qname, sample, 2 FROM whole WHERE ok2) w USING (qname, sample)
  UNION
  SELECT v.qname, v.sample, v.side, v.own, left(v.seq, (a.read_pos - 1)::INTEGER) || CASE WHEN c.h = 0 THEN a.allele1 ELSE a.allele2 END || substr(v.seq, (a.read_pos + 1)::INTEGER), v.k + 1
  FROM grown v JOIN placed a ON a.qname = v.qname AND a.sample = v.sample AND a.k = v.k, unnest(CASE WHEN a.hap1 <> a.hap2 AND NOT a.phased THEN [a.hap1, a.hap2] WHEN v.side = 1 THEN [a.hap1] ELSE [a.hap2] END) AS c(h)),
final AS (SELECT DISTINCT v.qname, v.seq, v.own FROM grown v JOIN whole w ON w.qname = v.qname AND w.sample = v.sample AND v.k = w.last + 1)""".format(phased=phased)
    return with_sql(*BASE, GENOTYPES, FEW, SITES, parts, body="SELECT qname, count(*) AS n_seqs, count(*) FILTER (WHERE seq <> own) AS n_versions, min(seq) AS first_seq, max(seq) AS last_seq FROM final GROUP BY qname").replace("WITH ", "WITH RECURSIVE ", 1)


def _haplotype_versions(spark: SparkSession, sf_dir: str, genotypes: DataFrame) -> DataFrame:
    reads = usable(views.reads(spark, sf_dir))
    made = split.expanded(split.sites_of(reads, views.snps(spark, sf_dir), most=split.MAX_SNPS), genotypes)
    return made.where(F.size("seqs") > 0).select("qname", F.size("seqs").cast("long").alias("n_seqs"), F.size(F.array_except("seqs", F.array("seq"))).cast("long").alias("n_versions"), F.array_min("seqs").alias("first_seq"), F.array_max("seqs").alias("last_seq"))


@query(_haplotype_sql("true"))
def versions_haplotype_phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of reads by the samples' haplotypes, all taken as phased."""
    return _haplotype_versions(spark, sf_dir, views.genotypes(spark, sf_dir).withColumn("phased", F.lit(True)))


@query(_haplotype_sql("g.phased"))
def versions_haplotype_unphased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of reads by the samples' haplotypes, with both alleles where phase is unknown."""
    return _haplotype_versions(spark, sf_dir, views.genotypes(spark, sf_dir))


PAIRED = f"paired AS (SELECT * FROM pairs WHERE {DISPOSITION} = 'paired')"
MATED = "mated AS (SELECT chrom, qname, arg_min(struct_pack(pos := pos, seq := seq, mate_pos := mate_pos), (pos, mate)) AS a, arg_max(struct_pack(pos := pos, seq := seq, mate_pos := mate_pos), (pos, mate)) AS b FROM paired GROUP BY chrom, qname HAVING count(*) = 2)"


@query(with_sql(PAIRS, PAIRED, body="SELECT x.qname, x.chrom, x.pos AS pos_a, y.pos AS pos_b, y.mate_pos = x.pos AS ok FROM paired x JOIN paired y ON x.qname = y.qname AND x.chrom = y.chrom AND (x.pos, x.mate) < (y.pos, y.mate)"))
def pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates brought together."""
    both, _ = split.mates(views.pairs(spark, sf_dir))
    return both.select("qname", "chrom", F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), "ok")


@query(with_sql(PAIRS, PAIRED, body="SELECT qname, chrom, count(*)::INTEGER AS n FROM paired GROUP BY qname, chrom HAVING count(*) <> 2"))
def pair_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose mate is missing."""
    return split.mates(views.pairs(spark, sf_dir))[1]


PAIR_HITS = f"""own AS (
  SELECT x.qname, x.chrom, x.pos, x.seq, x.mate, (x.pos, x.mate) < (y.pos, y.mate) AS is_a, CASE WHEN (x.pos, x.mate) < (y.pos, y.mate) THEN y.mate_pos = x.pos ELSE x.mate_pos = y.pos END AS ok
  FROM paired x JOIN paired y ON x.qname = y.qname AND x.chrom = y.chrom AND x.mate <> y.mate),
phits AS (SELECT o.qname, o.is_a, o.seq, s.pos AS site, s.pos - o.pos + 1 AS read_pos, allele1, allele2, {SIMPLE} AS is_snp, substr(o.seq, (s.pos - o.pos + 1)::INTEGER, 1) AS base FROM own o JOIN snps s ON s.chrom = o.chrom AND s.pos BETWEEN o.pos AND o.pos + 31 WHERE ok),
pstate AS (SELECT qname, count(*) FILTER (WHERE NOT is_snp) AS indels, greatest(count(*) FILTER (WHERE is_snp AND is_a), count(*) FILTER (WHERE is_snp AND NOT is_a)) AS snps FROM phits GROUP BY qname),
shared AS (SELECT a.qname, count(*) AS n_shared, bool_or(a.base <> b.base) AS discordant FROM phits a JOIN phits b ON a.qname = b.qname AND a.site = b.site AND a.is_a AND NOT b.is_a WHERE a.is_snp GROUP BY a.qname)"""


@query(with_sql(PAIRS, PAIRED, SNPS, PAIR_HITS, body="SELECT qname, n_shared, discordant FROM shared"))
def pair_product_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose mates cover the same SNPs, and whether they disagree there."""
    both, _ = split.mates(views.pairs(spark, sf_dir))
    return split.shared_sites(both.where("ok"), views.snps(spark, sf_dir))


@query(with_sql(PAIRS, PAIRED, SNPS, PAIR_HITS, body="""SELECT CASE WHEN NOT ok THEN 'mate_pos_mismatch' WHEN indels > 0 THEN 'indel' WHEN snps > 6 THEN 'excess_snps' WHEN discordant THEN 'discordant' WHEN coalesce(snps, 0) = 0 THEN 'keep' ELSE 'versions' END AS disposition, count(*) AS n
FROM own LEFT JOIN pstate USING (qname) LEFT JOIN shared USING (qname) WHERE is_a GROUP BY 1"""))
def split_pairs_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by what becomes of them; those with versions to try count together."""
    rows, _ = split.split_pairs(views.pairs(spark, sf_dir), views.snps(spark, sf_dir))
    return rows.withColumn("disposition", F.when(F.col("disposition").isin("remap", "excess_versions"), "versions").otherwise(F.col("disposition"))).groupBy("disposition").agg(F.count("*").alias("n"))


PAIR_VERSIONS = """psites AS (SELECT qname, is_a, read_pos, site, allele1, allele2, row_number() OVER (PARTITION BY qname, is_a ORDER BY read_pos, site) AS k FROM phits WHERE is_snp),
fair AS (SELECT o.qname, o.is_a, o.seq AS own FROM own o LEFT JOIN pstate s USING (qname) LEFT JOIN shared h USING (qname) WHERE o.ok AND coalesce(s.indels, 0) = 0 AND coalesce(s.snps, 0) <= 6 AND NOT coalesce(h.discordant, false)),
grown AS (
  SELECT qname, is_a, own, own AS seq, 1 AS k FROM fair
  UNION
  SELECT v.qname, v.is_a, v.own, left(v.seq, (s.read_pos - 1)::INTEGER) || a.allele || substr(v.seq, (s.read_pos + 1)::INTEGER), v.k + 1
  FROM grown v JOIN psites s ON s.qname = v.qname AND s.is_a = v.is_a AND s.k = v.k, unnest([substr(v.seq, s.read_pos::INTEGER, 1), s.allele1, s.allele2]) AS a(allele)),
ends AS (SELECT DISTINCT v.qname, v.is_a, v.own, v.seq FROM grown v LEFT JOIN (SELECT qname, is_a, max(k) AS last FROM psites GROUP BY ALL) l USING (qname, is_a) WHERE v.k = coalesce(l.last, 0) + 1),
few AS (SELECT qname FROM ends GROUP BY qname HAVING count(*) <= 64),
keyed AS (SELECT e.qname, e.is_a, e.own, e.seq, coalesce((SELECT string_agg(substr(e.seq, p.read_pos::INTEGER, 1), '' ORDER BY p.site) FROM psites p WHERE p.qname = e.qname AND p.is_a = e.is_a AND EXISTS (SELECT 1 FROM psites q WHERE q.qname = p.qname AND q.is_a <> p.is_a AND q.site = p.site)), '') AS key FROM ends e JOIN few USING (qname)),
product AS (SELECT DISTINCT x.qname, x.own AS own_a, y.own AS own_b, x.seq AS seq_a, y.seq AS seq_b FROM keyed x JOIN keyed y ON x.qname = y.qname AND x.key = y.key AND x.is_a AND NOT y.is_a),
sized AS (SELECT *, count(*) OVER (PARTITION BY qname) - 1 AS n_versions FROM product),
made AS (SELECT * FROM sized WHERE n_versions <= 64)"""
PAIR_BASE = (PAIRS, PAIRED, SNPS, PAIR_HITS, PAIR_VERSIONS)


@query(with_sql(*PAIR_BASE, body="""SELECT CASE WHEN NOT o.ok THEN 'mate_pos_mismatch' WHEN indels > 0 THEN 'indel' WHEN snps > 6 THEN 'excess_snps' WHEN discordant THEN 'discordant' WHEN m.qname IS NULL THEN 'excess_versions' WHEN coalesce(snps, 0) = 0 THEN 'keep' ELSE 'remap' END AS disposition, count(*) AS n
FROM own o LEFT JOIN pstate USING (qname) LEFT JOIN shared USING (qname) LEFT JOIN (SELECT DISTINCT qname FROM made) m USING (qname) WHERE is_a GROUP BY 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def split_pairs_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by what becomes of them, those with too many versions apart."""
    rows, _ = split.split_pairs(views.pairs(spark, sf_dir), views.snps(spark, sf_dir))
    return rows.groupBy("disposition").agg(F.count("*").alias("n"))


@query(with_sql(*PAIR_BASE, body="""SELECT m.qname, o.pos AS pos_a, o.mate_pos AS pos_b, row_number() OVER (PARTITION BY m.qname ORDER BY seq_a, seq_b) AS version_no, n_versions, m.qname::VARCHAR || '.' || o.pos::VARCHAR || '-' || o.mate_pos::VARCHAR || '.' || (row_number() OVER (PARTITION BY m.qname ORDER BY seq_a, seq_b))::VARCHAR || '.' || n_versions::VARCHAR AS name, seq_a, seq_b
FROM made m JOIN (SELECT x.qname, x.pos, y.pos AS mate_pos FROM own x JOIN own y ON x.qname = y.qname AND x.is_a AND NOT y.is_a) o USING (qname) JOIN pstate s USING (qname) WHERE s.snps > 0 AND NOT (seq_a = own_a AND seq_b = own_b)""").replace("WITH ", "WITH RECURSIVE ", 1))
def split_pairs_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of pairs whose mates agree at shared SNPs."""
    return split.split_pairs(views.pairs(spark, sf_dir), views.snps(spark, sf_dir))[1].withColumns({c: F.col(c).cast("long") for c in ("version_no", "n_versions")})


@query(with_sql(READS, body="SELECT qname || '.x' AS orig_name, pos AS exp_pos1, pos + 7 AS exp_pos2, 1 AS version_no, 3 AS n_versions, qname || '.x.' || pos::VARCHAR || '-' || (pos + 7)::VARCHAR || '.1.3' AS name, '@' || qname || chr(10) || reverse(translate(seq, 'ACGT', 'TGCA')) || chr(10) || '+' || chr(10) || repeat('B', 32) AS record FROM reads"))
def fastq_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of versions written and read back, and second reads' FASTQ records."""
    r = views.reads(spark, sf_dir)
    name = alleles.encode_name(F.concat("qname", F.lit(".x")), [F.col("pos"), F.col("pos") + 7], F.lit(1), F.lit(3))
    record = F.concat(F.lit("@"), F.col("qname"), F.lit("\n"), seq.reverse_complement(F.col("seq")), F.lit("\n+\n"), F.lit("B" * 32))
    return r.select(name.alias("name"), record.alias("record")).select(alleles.decode_name(F.col("name")).alias("d"), "name", "record").select("d.*", "name", "record")


def remapped_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reads to align again, and what came back: two versions of each, most of them where they were."""
    r = usable(views.reads(spark, sf_dir)).select("qname", "chrom", "pos", "cigar")
    each = r.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))
    key = F.concat_ws("-", "qname", F.col("v").cast("string"))
    kind = hashed("k", key) % 12
    back = each.where(kind != 0).select(
        alleles.encode_name(F.col("qname"), [F.col("pos")], F.col("v"), F.lit(2)).alias("name"),
        F.when(kind == 1, 256).otherwise(0).alias("flag"), "chrom", F.when(kind == 2, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"), F.lit(None).cast("long").alias("mate_pos"), F.when(kind == 3, F.lit("31M1S")).otherwise(F.col("cigar")).alias("cigar"))
    return r, back


_VKEY = "(qname || '-' || v::VARCHAR)"
REMAP = f"""r AS (SELECT qname, chrom, pos, cigar FROM reads WHERE flag IN (0, 16)),
back AS (SELECT qname, kind, CASE WHEN kind = 3 THEN '31M1S' ELSE cigar END AS cigar FROM (SELECT r.*, v, {h("k", _VKEY)} % 12 AS kind FROM r, (VALUES (1), (2)) AS t(v)) AS x WHERE kind <> 0),
tally AS (SELECT qname, bool_or(kind = 1) AS poisoned, count(*) FILTER (WHERE kind = 2) AS n_wrong, count(*) FILTER (WHERE kind <> 2) AS n_right, list_sort(list(DISTINCT cigar)) AS cigars FROM back GROUP BY qname),
verdicts AS (SELECT r.qname, r.pos, CASE WHEN n_right IS NULL THEN 'missing' WHEN poisoned THEN 'poisoned' WHEN n_wrong > 0 THEN 'wrong_place' WHEN n_right <> 2 THEN 'incomplete' WHEN cigars <> [r.cigar] THEN 'cigar_changed' ELSE 'keep' END AS verdict FROM r LEFT JOIN tally USING (qname))"""


@query(with_sql(READS, REMAP, body="SELECT qname, verdict FROM verdicts"))
def remap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided on each read whose versions were aligned again."""
    return remap.remap_verdict(*remapped_pairs(spark, sf_dir)).select("qname", "verdict")


@query(with_sql(READS, REMAP, body="SELECT qname, pos FROM verdicts WHERE verdict = 'keep' UNION ALL SELECT qname, pos FROM reads WHERE flag = 2048"))
def keep_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads kept at once (here the supplementary ones) and those kept after their versions came back."""
    keep = views.reads(spark, sf_dir).where("flag = 2048").select("qname", "pos")
    return remap.kept(keep, remap.remap_verdict(*remapped_pairs(spark, sf_dir)))


@query(with_sql(READS, body="SELECT qname, chrom, pos, flag FROM reads WHERE flag IN (0, 16) QUALIFY row_number() OVER (PARTITION BY chrom, pos, flag ORDER BY md5(qname || '|0'), qname) = 1"))
def rmdup_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read of each position and strand."""
    return remap.dedup_single(views.reads(spark, sf_dir)).select("qname", "chrom", "pos", "flag")


@query(with_sql(PAIRS, f"u AS (SELECT * FROM pairs WHERE {DUPLICATE} = 'paired')", "names AS (SELECT chrom, qname, least(pos, mate_pos) AS lo, greatest(pos, mate_pos) AS hi FROM u GROUP BY ALL HAVING count(*) = 2)", "chosen AS (SELECT chrom, qname FROM names QUALIFY row_number() OVER (PARTITION BY chrom, lo, hi ORDER BY md5(qname::VARCHAR || '|0'), qname) = 1)", body="SELECT u.qname, u.mate, u.chrom, u.pos FROM u JOIN chosen USING (chrom, qname)"))
def rmdup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair of those at the same two positions."""
    return remap.dedup_pairs(views.pairs(spark, sf_dir)).select("qname", "mate", "chrom", "pos")


@query(with_sql(*BASE, f"clean AS (SELECT b.* FROM hits b JOIN (SELECT qname FROM hits GROUP BY qname HAVING bool_and(is_snp)) USING (qname) WHERE {USABLE})", "one AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY qname ORDER BY md5(qname || '|' || pos::VARCHAR || '|0')) = 1)", body=f"SELECT chrom, pos AS site, allele1 AS ref, allele2 AS alt, {COUNTS} FROM one GROUP BY ALL"))
def as_counts_one_snp_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele counts with one site of each read, chosen by hash; reads over an indel count nowhere."""
    return counts.allele_counts(counts.one_site_per_read(counts.usable_hits(hits(spark, sf_dir))))


@query(with_sql(READS, body="SELECT chrom, pos, least(count(*), 65535) AS n FROM reads WHERE flag IN (0, 16) GROUP BY chrom, pos"))
def read_start_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that start at each position, up to what two bytes hold."""
    return counts.start_depth(usable(views.reads(spark, sf_dir)), 65_535)


@query(with_sql(READS, body="SELECT chrom, pos // 100 AS bin, least(count(*), 255) AS n FROM reads WHERE flag IN (0, 16) GROUP BY ALL"))
def depth_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by hundred positions, up to 255."""
    r = usable(views.reads(spark, sf_dir)).withColumn("bin", F.floor(F.col("pos") / 100))
    return counts.start_depth(r, 255, ("chrom", "bin"))


DEPTH = "depth AS (SELECT chrom, pos, count(*) AS n FROM reads WHERE flag IN (0, 16) GROUP BY chrom, pos)"


@query(with_sql(READS, DEPTH, body="SELECT chrom, count(n) AS n, count(*) FILTER (WHERE n IS NULL) AS n_null, min(n) AS least, max(n) AS most, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean FROM depth GROUP BY ROLLUP (chrom)"))
def chrom_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the depth track by chromosome and over all."""
    return counts.track_stats(counts.start_depth(usable(views.reads(spark, sf_dir)))).withColumn("mean", F.round("mean", 6))


@query(with_sql(READS, body="SELECT individual, count(*) AS n FROM reads WHERE flag IN (0, 16) GROUP BY individual"))
def genomewide_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each individual."""
    return usable(views.reads(spark, sf_dir)).groupBy("individual").agg(F.count("*").alias("n"))


@query(with_sql(*BASE, AS_COUNTS, body="SELECT chrom, site, sum(ref_n)::BIGINT AS ref_n, sum(alt_n)::BIGINT AS alt_n, sum(other_n)::BIGINT AS other_n FROM as_counts GROUP BY chrom, site"))
def combined_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele counts summed over individuals."""
    return counts.combined_counts(as_counts(spark, sf_dir))


@query(with_sql(*BASE, GENOTYPES, AS_COUNTS, "everyone AS (SELECT individual FROM genotypes UNION SELECT individual FROM as_counts)", body="""SELECT e.individual, s.chrom, s.pos, s.allele1, s.allele2, coalesce(c.ref_n, 0) AS ref_n, coalesce(c.alt_n, 0) AS alt_n, coalesce(c.other_n, 0) AS other_n, coalesce(g.hap1::VARCHAR || '|' || g.hap2::VARCHAR, 'NA') AS genotype
FROM snps s CROSS JOIN everyone e LEFT JOIN as_counts c ON c.chrom = s.chrom AND c.site = s.pos AND c.individual = e.individual LEFT JOIN genotypes g ON g.chrom = s.chrom AND g.pos = s.pos AND g.individual = e.individual"""))
def as_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every individual: every variant, with counts and genotype."""
    out = counts.dense_report(views.snps(spark, sf_dir), as_counts(spark, sf_dir), views.genotypes(spark, sf_dir), by=("individual",))
    return out.select("individual", "chrom", "pos", "allele1", "allele2", "ref_n", "alt_n", "other_n", "genotype")


GCOUNT = "gcount AS (SELECT chrom, pos, count(*) FILTER (WHERE hap1 + hap2 = 1) AS het, least(count(*) FILTER (WHERE hap1 + hap2 = 1) + 2 * count(*) FILTER (WHERE hap1 + hap2 = 0), count(*) FILTER (WHERE hap1 + hap2 = 1) + 2 * count(*) FILTER (WHERE hap1 + hap2 = 2)) AS minor_n FROM genotypes GROUP BY chrom, pos)"
TARGETS = f"""targets AS (SELECT s.chrom, s.pos, s.pos + 1 AS end_pos, s.chrom || '.' || (greatest(s.pos - {HALF}, 1) + 1)::VARCHAR AS name, s.allele1 AS ref, s.allele2 AS alt, greatest(s.pos - {HALF}, 1) AS start, s.pos + {HALF} AS stop, g.het, g.minor_n, coalesce(a.as_n, 0)::BIGINT AS as_n, d.region_n::BIGINT AS region_n
  FROM snps s JOIN gcount g USING (chrom, pos) LEFT JOIN (SELECT chrom, site AS pos, sum(ref_n + alt_n) AS as_n FROM as_counts GROUP BY chrom, site) a USING (chrom, pos)
  JOIN (SELECT s2.chrom, s2.pos, sum(d.n) AS region_n FROM snps s2 JOIN depth d ON d.chrom = s2.chrom AND d.pos BETWEEN s2.pos - {HALF} AND s2.pos + {HALF} GROUP BY s2.chrom, s2.pos) d USING (chrom, pos)
  WHERE g.het >= 1 AND g.minor_n >= 1 AND coalesce(a.as_n, 0) >= 1 AND d.region_n >= 5)"""
TARGET_BASE = (*BASE, GENOTYPES, AS_COUNTS, DEPTH, GCOUNT, TARGETS)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = counts.start_depth(usable(views.reads(spark, sf_dir)))
    return regions.target_regions(views.snps(spark, sf_dir), counts.genotype_counts(views.genotypes(spark, sf_dir)), as_counts(spark, sf_dir), depth, 2 * HALF, min_as=1, min_reads=5)


@query(with_sql(*TARGET_BASE, body="SELECT * FROM targets"))
def target_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions about variants with enough reads, alleles and heterozygotes."""
    return targets(spark, sf_dir)


@query(with_sql(*BASE, DEPTH, body=f"SELECT s.chrom, s.pos, coalesce(sum(d.n), 0)::BIGINT AS region_n FROM snps s LEFT JOIN depth d ON d.chrom = s.chrom AND d.pos BETWEEN s.pos - {HALF} AND s.pos + {HALF} GROUP BY s.chrom, s.pos"))
def window_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth in a window about every variant, by RANGE frame."""
    depth = counts.start_depth(usable(views.reads(spark, sf_dir)))
    return regions.window_sums_binned(depth, views.snps(spark, sf_dir).select("chrom", "pos"), HALF)


def two_part_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of two parts about each variant."""
    s = views.snps(spark, sf_dir)
    return s.select(F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("region_id"), "chrom", F.col("pos").alias("test_pos"), F.array(F.greatest(F.col("pos") - 50, F.lit(1)), F.col("pos") + 100).alias("starts"), F.array(F.col("pos") + 50, F.col("pos") + 150).alias("stops"))


PARTS = "parts AS (SELECT chrom || ':' || pos::VARCHAR AS region_id, chrom, pos AS test_pos, greatest(pos - 50, 1) AS a, pos + 50 AS z FROM snps UNION ALL SELECT chrom || ':' || pos::VARCHAR, chrom, pos, pos + 100, pos + 150 FROM snps)"


@query(with_sql(SNPS, PARTS, body="SELECT DISTINCT p.region_id, p.chrom, s.pos, s.snp_idx FROM parts p JOIN snps s ON s.chrom = p.chrom AND s.pos BETWEEN p.a AND p.z"))
def region_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants in each region of two parts."""
    return regions.points_in_regions(two_part_regions(spark, sf_dir), views.snps(spark, sf_dir).select("chrom", "pos", "snp_idx"))


@query(with_sql(*BASE, DEPTH, PARTS, body="SELECT p.region_id, coalesce(sum(d.n), 0)::BIGINT AS region_n FROM parts p LEFT JOIN depth d ON d.chrom = p.chrom AND d.pos BETWEEN p.a AND p.z GROUP BY p.region_id"))
def region_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth in each region of two parts."""
    return regions.region_sums(two_part_regions(spark, sf_dir), counts.start_depth(usable(views.reads(spark, sf_dir))))


def oriented(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = haplotypes.region_lists(two_part_regions(spark, sf_dir), views.genotypes(spark, sf_dir), as_counts(spark, sf_dir), mode=mode)
    return rows.where("region_snps IS NOT NULL")


def _oriented_sql(mode: str) -> str:
    coin_key = "region_id || '|' || individual::VARCHAR" + (" || '|' || pos::VARCHAR" if mode == "rand_allele" else "")
    coin = f"('0x' || substr(md5({coin_key} || '|0'), 1, 1))::BIGINT % 2 = 1"
    first, second = ("CASE WHEN hap1 = 0 THEN r ELSE a END", "CASE WHEN hap1 = 0 THEN a ELSE r END") if mode == "rand_hap" else ("r", "a")
    free_ref, free_alt = ("0", "0") if mode == "zero" else (f"CASE WHEN {coin} THEN {second} ELSE {first} END", f"CASE WHEN {coin} THEN {first} ELSE {second} END")
    same = "CASE WHEN test_hap1 = 0 THEN hap1 = 0 ELSE hap2 = 0 END"
    return with_sql(*BASE, GENOTYPES, AS_COUNTS, PARTS, f"""sites AS (SELECT DISTINCT p.region_id, p.chrom, p.test_pos, s.pos FROM parts p JOIN snps s ON s.chrom = p.chrom AND s.pos BETWEEN p.a AND p.z),
placed AS (SELECT s.*, g.individual, g.hap1, g.hap2, CASE WHEN t.hap1 <> t.hap2 THEN t.hap1 END AS test_hap1, coalesce(c.ref_n, 0) AS r, coalesce(c.alt_n, 0) AS a, coalesce(c.other_n, 0) AS other_n
  FROM sites s JOIN genotypes g ON g.chrom = s.chrom AND g.pos = s.pos AND g.hap1 <> g.hap2 LEFT JOIN genotypes t ON t.chrom = s.chrom AND t.pos = s.test_pos AND t.individual = g.individual LEFT JOIN as_counts c ON c.chrom = s.chrom AND c.site = s.pos AND c.individual = g.individual)""",
        body=f"""SELECT region_id, individual, count(*) AS n_sites, sum(ref_n)::BIGINT AS ref_n, sum(alt_n)::BIGINT AS alt_n, sum(other_n)::BIGINT AS other_n FROM (SELECT region_id, individual, other_n,
  CASE WHEN test_hap1 IS NOT NULL THEN CASE WHEN {same} THEN r ELSE a END ELSE {free_ref} END AS ref_n, CASE WHEN test_hap1 IS NOT NULL THEN CASE WHEN {same} THEN a ELSE r END ELSE {free_alt} END AS alt_n FROM placed) AS x GROUP BY region_id, individual""")


def _oriented_query(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        total = lambda f: F.aggregate("region_snps", F.lit(0).cast("long"), lambda t, s: t + s[f]).alias(f)
        return oriented(spark, sf_dir, mode).select("region_id", "individual", F.size("region_snps").cast("long").alias("n_sites"), *map(total, ("ref_n", "alt_n", "other_n")))

    run.__name__, run.__doc__ = f"hap_oriented_counts_{mode}", f"Counts of each haplotype by region and individual, mode {mode}."
    return run


for _mode in haplotypes.MODES:
    query(_oriented_sql(_mode))(_oriented_query(_mode))


def input_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the combined test for every region of two parts and individual."""
    reads = usable(views.reads(spark, sf_dir))
    g = views.genotypes(spark, sf_dir)
    snps = views.snps(spark, sf_dir).select("chrom", F.col("pos").alias("test_pos"), F.col("name").alias("test_id"), F.col("allele1").alias("ref"), F.col("allele2").alias("alt"))
    rows = two_part_regions(spark, sf_dir).join(snps, ["chrom", "test_pos"])
    depth = counts.start_depth(reads, by=("individual", "chrom", "pos"))
    genome = reads.groupBy("individual").agg(F.count("*").alias("genome_n"))
    return haplotypes.input_rows(rows, g, as_counts(spark, sf_dir), depth, genome)


INPUT_BASE = (*BASE, GENOTYPES, AS_COUNTS, PARTS, "idepth AS (SELECT individual, chrom, pos, count(*) AS n FROM reads WHERE flag IN (0, 16) GROUP BY ALL)", "rdepth AS (SELECT p.region_id, d.individual, sum(d.n)::BIGINT AS region_reads FROM parts p JOIN idepth d ON d.chrom = p.chrom AND d.pos BETWEEN p.a AND p.z GROUP BY ALL)", "genome_n AS (SELECT individual, count(*) AS genome_reads FROM reads WHERE flag IN (0, 16) GROUP BY individual)")


@query(with_sql(*INPUT_BASE, body="SELECT g.chrom || ':' || g.pos::VARCHAR AS region_id, g.individual, s.name AS test_id, (hap1 + hap2)::DOUBLE AS genotype, hap1::VARCHAR || '|' || hap2::VARCHAR AS haplotype, coalesce(r.region_reads, 0) AS region_reads, n.genome_reads FROM genotypes g JOIN snps s USING (chrom, pos) LEFT JOIN rdepth r ON r.region_id = g.chrom || ':' || g.pos::VARCHAR AND r.individual = g.individual LEFT JOIN genome_n n ON n.individual = g.individual"))
def cht_input_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the combined test, without their lists of sites."""
    return input_rows(spark, sf_dir).select("region_id", "individual", "test_id", "genotype", "haplotype", "region_reads", "genome_reads")


SITES_OF_ROWS = """rsites AS (SELECT DISTINCT p.region_id, p.chrom, p.test_pos, s.pos FROM parts p JOIN snps s ON s.chrom = p.chrom AND s.pos BETWEEN p.a AND p.z),
rplaced AS (SELECT s.*, g.individual, CASE WHEN t.hap1 <> t.hap2 THEN CASE WHEN t.hap1 = 0 THEN g.hap1 = 0 ELSE g.hap2 = 0 END END AS same, coalesce(c.ref_n, 0) AS r, coalesce(c.alt_n, 0) AS a, coalesce(c.other_n, 0) AS o
  FROM rsites s JOIN genotypes g ON g.chrom = s.chrom AND g.pos = s.pos AND g.hap1 <> g.hap2 LEFT JOIN genotypes t ON t.chrom = s.chrom AND t.pos = s.test_pos AND t.individual = g.individual LEFT JOIN as_counts c ON c.chrom = s.chrom AND c.site = s.pos AND c.individual = g.individual),
rturned AS (SELECT region_id, individual, pos, CASE WHEN same THEN r WHEN NOT same THEN a ELSE 0 END AS ref_n, CASE WHEN same THEN a WHEN NOT same THEN r ELSE 0 END AS alt_n, o AS other_n FROM rplaced),
rlists AS (SELECT region_id, individual, count(*) AS n_sites, sum(ref_n + alt_n)::BIGINT AS as_n, string_agg(pos::VARCHAR, ';' ORDER BY pos) AS ps, string_agg('1.00', ';') AS ones, string_agg(ref_n::VARCHAR, ';' ORDER BY pos) AS rs, string_agg(alt_n::VARCHAR, ';' ORDER BY pos) AS als, string_agg(other_n::VARCHAR, ';' ORDER BY pos) AS os FROM rturned GROUP BY ALL),
text_rows AS (SELECT g.chrom, g.pos AS test_pos, g.individual, s.name AS test_id, s.allele1 AS ref, s.allele2 AS alt, (hap1 + hap2)::DOUBLE AS genotype, hap1::VARCHAR || '|' || hap2::VARCHAR AS haplotype, greatest(g.pos - 50, 1)::VARCHAR || ';' || (g.pos + 100)::VARCHAR AS starts, (g.pos + 50)::VARCHAR || ';' || (g.pos + 150)::VARCHAR AS stops,
  n_sites, as_n, ps, ones, rs, als, os, coalesce(d.region_reads, 0) AS region_reads, n.genome_reads::DOUBLE AS genome_reads
  FROM genotypes g JOIN snps s USING (chrom, pos) LEFT JOIN rlists l ON l.region_id = g.chrom || ':' || g.pos::VARCHAR AND l.individual = g.individual LEFT JOIN rdepth d ON d.region_id = g.chrom || ':' || g.pos::VARCHAR AND d.individual = g.individual LEFT JOIN genome_n n ON n.individual = g.individual)"""


@query(with_sql(*INPUT_BASE, SITES_OF_ROWS, body="""SELECT concat_ws(' ', chrom, test_pos::VARCHAR, test_id, ref, alt, coalesce(printf('%.2f', genotype), 'NA'), coalesce(haplotype, 'NA'), starts, stops, coalesce(ps, 'NA'), coalesce(ones, 'NA'), coalesce(ones, 'NA'), coalesce(rs, 'NA'), coalesce(als, 'NA'), coalesce(os, 'NA'), region_reads::VARCHAR, coalesce(printf('%.2f', genome_reads), 'NA')) AS value FROM text_rows"""))
def cht_input_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the combined test as text lines."""
    return tables.input_text(input_rows(spark, sf_dir))


@query(with_sql(*INPUT_BASE, body="SELECT region_id, individual, genome_reads, round(CASE WHEN low > 0 THEN genome_reads * 1.0 / low ELSE genome_reads END, 6) AS scale FROM (SELECT g.chrom || ':' || g.pos::VARCHAR AS region_id, g.individual, genome_reads, min(genome_reads) OVER (PARTITION BY g.chrom, g.pos) AS low FROM genotypes g JOIN genome_n n ON n.individual = g.individual) AS x"))
def total_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the least total of their region."""
    own = views.genotypes(spark, sf_dir).join(F.broadcast(usable(views.reads(spark, sf_dir)).groupBy("individual").agg(F.count("*").alias("genome_reads"))), "individual")  # a row per individual
    rows = own.select(F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("region_id"), "individual", "genome_reads")
    return haplotypes.rescaled(rows).select("region_id", "individual", "genome_reads", F.round("scale", 6).alias("scale"))


@query("SELECT doc, string_agg(pos::VARCHAR || ':' || tag::VARCHAR, ';' ORDER BY pos) AS kept, count(*) AS n FROM (SELECT l_orderkey AS doc, l_partkey % 7 AS pos, min(l_partkey) AS tag FROM lineitem GROUP BY 1, 2) AS x GROUP BY doc")
def dedupe_region_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated positions of a list: the first of each stays."""
    li = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct((F.col("l_partkey") % 7).alias("pos"), F.col("l_partkey").alias("tag"))).alias("snps"))
    kept = haplotypes.first_per_position(F.col("snps"))
    return li.select("doc", F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["pos"].cast("string"), s["tag"].cast("string"))), ";").alias("kept"), F.size(kept).cast("long").alias("n"))


@query(with_sql(*BASE, AS_COUNTS, body="""SELECT individual, chrom, site, round(CASE WHEN good - bad > 40 THEN 1.0 ELSE 0.9 * exp(good - bad) / (0.9 * exp(good - bad) + 0.1) END, 6) AS posterior FROM (SELECT individual, chrom, site, ln(0.5) * (ref_n + alt_n) AS good,
  greatest(x, y) + ln(1 + exp(-abs(x - y))) AS bad FROM (SELECT *, ln(0.01) * ref_n + ln(0.99) * alt_n AS x, ln(0.99) * ref_n + ln(0.01) * alt_n AS y FROM as_counts) AS c) AS d"""))
def het_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of a heterozygote given counts, from a prior of 0.9."""
    return as_counts(spark, sf_dir).select("individual", "chrom", "site", F.round(likelihood.het_posterior(F.lit(0.9), F.col("ref_n"), F.col("alt_n")), 6).alias("posterior"))


@query(with_sql(SNPS, PARTS, SEQUENCE, body="SELECT region_id, sum(length(c) - length(translate(c, 'GC', '')))::BIGINT AS gc, sum(length(c) - length(translate(c, 'AT', '')))::BIGINT AS at, round(sum(length(c) - length(translate(c, 'GC', ''))) * 1.0 / sum(length(c)), 6) AS gc_fraction FROM (SELECT region_id, substr(g.bases, (greatest(p.a - g.chunk_start, 0) + 1)::INTEGER, (least(p.z - g.chunk_start, 31) - greatest(p.a - g.chunk_start, 0) + 1)::INTEGER) AS c FROM parts p JOIN genome g ON g.chrom = p.chrom AND g.chunk_start BETWEEN p.a - 31 AND p.z) AS x GROUP BY region_id"))
def gc_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GC content of each region of two parts."""
    return regions.region_bases(two_part_regions(spark, sf_dir), views.sequence(spark, sf_dir)).withColumn("gc_fraction", F.round("gc_fraction", 6))


@query("SELECT p_partkey, round(exp(0.1 + 0.5 * gc - 0.3 * gc * gc + 0.2 * gc * gc * gc - 0.1 * gc * gc * gc * gc) * (0.01 * t + 0.001 * t * t - 0.00001 * t * t * t + 0.0000001 * t * t * t * t), 6) AS expected FROM (SELECT p_partkey, p_size / 100.0 AS gc, p_size::DOUBLE AS t FROM part) AS x")
def depth_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected depth by a given model."""
    c = [F.lit(x) for x in (0.1, 0.5, -0.3, 0.2, -0.1, 9.0, 0.01, 0.001, -0.00001, 0.0000001)]
    return load(spark, sf_dir, "part").select("p_partkey", F.round(likelihood.expected_depth(F.col("p_size") / 100.0, F.col("p_size").cast("double"), c), 6).alias("expected"))


_LB = "(lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"


def lb(a: str, b: str) -> str:
    return _LB.format(a=a, b=b)


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(u, w) + ln(1 + exp(-abs(u - w))), 5) AS loglik FROM (SELECT *, ln(0.95) + {lb("r + 5.5", "a + 3.3")} - {lb("5.5", "3.3")} AS u, ln(0.05) + greatest(e1, e2) + ln(1 + exp(-abs(e1 - e2))) AS w FROM (SELECT *, ln(0.005) * r + ln(0.995) * a AS e1, ln(0.005) * a + ln(0.995) * r AS e2 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS r, l_linenumber::DOUBLE AS a FROM lineitem) AS x) AS y) AS z""")
def betabinom_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta-binomial log-likelihoods of quantities."""
    sigma = F.lit((1 / 9.8) ** 0.5)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(likelihood.beta_binomial(5.5 / 8.8, sigma, F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(0.95)), 5).alias("loglik"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, round(-{lb("50.0", "k")} - ln(k) + {lb("a + 50.0", "b + k")} - {lb("a", "b")}, 5) AS loglik FROM (SELECT *, 50.0 / (50.0 + m) * 100.0 + 1 AS a, (1 - 50.0 / (50.0 + m)) * 100.0 AS b FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS k, 5.0 + l_linenumber AS m FROM lineitem) AS x) AS y""")
def bnb_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta-negative-binomial log-likelihoods of quantities."""
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(likelihood.beta_negative_binomial(F.col("l_quantity"), 5.0 + F.col("l_linenumber"), F.lit(0.1), F.lit(50.0)), 5).alias("loglik"))


VCF_ROWS = f"""v AS (SELECT p_partkey AS key, CASE WHEN {h("v", "p_partkey")} % 6 = 0 THEN './.' WHEN {h("v", "p_partkey")} % 6 = 1 THEN '0|2' ELSE ({h("v", "p_partkey")} // 6 % 2)::VARCHAR || CASE WHEN {h("v", "p_partkey")} % 2 = 0 THEN '|' ELSE '/' END || ({h("w", "p_partkey")} % 2)::VARCHAR END AS gt,
  CASE WHEN {h("w", "p_partkey")} % 9 = 0 THEN '.' ELSE '-' || (p_size / 10.0)::DECIMAL(5,1)::VARCHAR || ',-' || (p_partkey % 10 / 10.0)::DECIMAL(5,1)::VARCHAR || ',-' || (p_partkey % 30 / 10.0)::DECIMAL(5,1)::VARCHAR END AS gl FROM part)"""


def vcf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    a, b = hashed("v", key), hashed("w", key)
    gt = F.when(a % 6 == 0, "./.").when(a % 6 == 1, "0|2").otherwise(F.concat((F.floor(a / 6) % 2).cast("string"), F.when(a % 2 == 0, "|").otherwise("/"), (b % 2).cast("string")))
    one = lambda c: F.format_string("-%.1f", c / 10.0)
    gl = F.when(b % 9 == 0, ".").otherwise(F.concat_ws(",", one(F.col("p_size")), one(key % 10), one(key % 30)))
    return load(spark, sf_dir, "part").select(key.alias("key"), F.lit("GT:DP:GL").alias("format"), F.concat_ws(":", gt, F.lit("9"), gl).alias("sample"))


@query(with_sql(VCF_ROWS, body=r"SELECT key, CASE WHEN regexp_matches(gt, '^[01][|/][01]$') THEN left(gt, 1)::INTEGER END AS hap1, CASE WHEN regexp_matches(gt, '^[01][|/][01]$') THEN right(gt, 1)::INTEGER END AS hap2, NOT regexp_matches(gt, '^\d+/\d+$') AS phased FROM v"))
def vcf_gt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of sample columns."""
    rows = vcf_rows(spark, sf_dir)
    h1, h2, phased = vcf.parse_genotype(vcf.field(F.col("format"), F.col("sample"), "GT"))
    return rows.select("key", h1.cast("int").alias("hap1"), h2.cast("int").alias("hap2"), phased.alias("phased"))


@query(with_sql(VCF_ROWS, body="SELECT key, round(a / (a + b + c), 6) AS p_rr, round(b / (a + b + c), 6) AS p_ra, round(c / (a + b + c), 6) AS p_aa FROM (SELECT key, CASE WHEN gl = '.' THEN 1.0 ELSE pow(10.0, split_part(gl, ',', 1)::DOUBLE) END AS a, CASE WHEN gl = '.' THEN 1.0 ELSE pow(10.0, split_part(gl, ',', 2)::DOUBLE) END AS b, CASE WHEN gl = '.' THEN 1.0 ELSE pow(10.0, split_part(gl, ',', 3)::DOUBLE) END AS c FROM v) AS x"))
def vcf_gl_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype probabilities of sample columns."""
    p = vcf.genotype_probabilities(F.col("format"), F.col("sample"))
    return vcf_rows(spark, sf_dir).select("key", *(F.round(F.get(p, F.lit(i)), 6).alias(c) for i, c in enumerate(("p_rr", "p_ra", "p_aa"))))


@query("SELECT p_partkey, CASE WHEN list_position(string_split(p_type, ' '), 'BRASS') > 0 THEN (list_position(string_split(p_type, ' '), 'BRASS') - 1)::INTEGER END AS at FROM part")
def format_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of a label in a colon list."""
    return load(spark, sf_dir, "part").select("p_partkey", vcf.format_index(F.replace(F.col("p_type"), F.lit(" "), F.lit(":")), "BRASS").alias("at"))


_PROBABILITY = h("t", "(g.snp_idx::VARCHAR || g.sample)")


@query(with_sql(SNPS, GENOTYPES, body=f"SELECT g.chrom, g.pos, g.sample, round({_PROBABILITY} % 1000 / 1000.0, 3) AS p_rr, CASE WHEN g.pos % 3 > 0 THEN g.hap1 END AS hap1, CASE WHEN g.pos % 3 > 0 THEN g.hap2 END AS hap2 FROM genotypes g"))
def impute_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities with the haplotypes that there are for their positions."""
    g = views.genotypes(spark, sf_dir)
    probs = g.select("chrom", "pos", "sample", F.round(hashed("t", F.concat(F.col("snp_idx").cast("string"), "sample")) % 1000 / 1000.0, 3).alias("p_rr"))
    return impute.with_haplotypes(probs, g.where("pos % 3 > 0").select("chrom", "pos", "sample", "hap1", "hap2"))


NAMES = "names AS (SELECT DISTINCT CASE c_nationkey WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' WHEN 2 THEN 'chrM' WHEN 3 THEN 'chr6_hap1' WHEN 4 THEN 'chrUn_random' ELSE 'chr' || c_nationkey::VARCHAR END AS chrom FROM customer)"


@query(with_sql(NAMES, """f AS (SELECT chrom, regexp_matches(chrom, '_hap|_alt') AS is_hap, regexp_matches(chrom, 'random|^chrUn|_un') AND NOT regexp_matches(chrom, '_hap|_alt') AS is_rand, chrom = 'chrM' AS is_mito, chrom IN ('chrX', 'chrY') AS is_sex FROM names)""", body="SELECT chrom, is_hap, is_rand, is_mito, is_sex, NOT (is_hap OR is_rand OR is_mito OR is_sex) AS is_auto, (row_number() OVER (ORDER BY is_hap, is_rand, is_mito, is_sex, CASE WHEN regexp_matches(chrom, '^chr[0-9]+$') THEN lpad(substr(chrom, 4), 5, '0') ELSE substr(chrom, 4) END))::INTEGER AS idnum FROM f"))
def chrom_sort_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosome names classified and numbered."""
    k = F.col("c_nationkey")
    name = F.when(k == 0, "chrX").when(k == 1, "chrY").when(k == 2, "chrM").when(k == 3, "chr6_hap1").when(k == 4, "chrUn_random").otherwise(F.concat(F.lit("chr"), k.cast("string")))
    return chroms.numbered(load(spark, sf_dir, "customer").select(name.alias("chrom")).distinct()).select("chrom", "is_hap", "is_rand", "is_mito", "is_sex", "is_auto", "idnum")


@query(with_sql(SNPS, body="SELECT a.chrom, a.pos AS pos_a, b.pos AS pos_b, a.pos - 3 >= b.pos - 20 AND a.pos + 3 <= b.pos + 20 AS inside FROM snps a JOIN snps b ON a.chrom = b.chrom AND a.pos - 3 <= b.pos + 20 AND b.pos - 20 <= a.pos + 3"))
def coord_overlaps_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and long intervals about variants that overlap, and whether one is inside the other."""
    s = views.snps(spark, sf_dir)
    short, long = s.select("chrom", (F.col("pos") - 3).alias("start"), (F.col("pos") + 3).alias("stop"), F.col("pos").alias("pos_a")), s.select("chrom", (F.col("pos") - 20).alias("start"), (F.col("pos") + 20).alias("stop"), F.col("pos").alias("pos_b"))
    both = overlap.interval_intervals(short, long)
    return both.select("chrom", "pos_a", F.col("pos_b_b").alias("pos_b"), coords.within((F.col("start"), F.col("stop")), (F.col("start_b"), F.col("stop_b"))).alias("inside"))


@query(with_sql(READS, body="SELECT qname, reverse(translate(seq, 'ACGT', 'TGCA')) AS turned, length(seq) - length(translate(seq, 'GC', '')) AS gc FROM reads"))
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads turned about, with their G and C counted."""
    s = F.col("seq")
    return views.reads(spark, sf_dir).select("qname", seq.reverse_complement(s).alias("turned"), seq.count_bases(s, "GC").cast("long").alias("gc"))


@query("SELECT p_partkey, b AS base, CASE upper(b) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 5 END AS id, upper(b) IN ('A', 'C', 'G', 'T') AS is_real, upper(b) IN ('M', 'R', 'W', 'S', 'Y', 'K', 'N') AS is_ambiguous, position('N' IN upper(p_name)) > 0 AS has_n FROM (SELECT *, substr(p_name, 1, 1) AS b FROM part) AS x")
def nuc_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of letters as nucleotides."""
    b = F.substring("p_name", 1, 1)
    return load(spark, sf_dir, "part").select("p_partkey", b.alias("base"), seq.nucleotide_id(b).cast("int").alias("id"), seq.is_real_base(b).alias("is_real"), seq.is_ambiguous(b).alias("is_ambiguous"), seq.has_unknown(F.col("p_name")).alias("has_n"))


P_VALUES = f"p AS (SELECT p_partkey::VARCHAR AS region_id, {h('u', 'p_partkey')} % 100000 / 100000.0 AS p_value FROM part)"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("region_id"), (hashed("u", F.col("p_partkey")) % 100000 / 100000.0).alias("p_value"), (F.col("p_partkey") % 4 == 0).alias("is_effect"), (F.col("p_partkey") % 3).alias("sim"))


@query(with_sql(P_VALUES, body="SELECT region_id, round(row_number() OVER (ORDER BY p_value, region_id) * 1.0 / count(*) OVER (), 8) AS expected, round(-log10(greatest(p_value, 1e-20)), 6) AS log_p FROM p"))
def qq_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and observed quantiles of p values."""
    return association.expected_ranks(p_values(spark, sf_dir)).select("region_id", F.round("expected", 8).alias("expected"), F.round("log_p", 6).alias("log_p"))


@query(with_sql(P_VALUES, "q AS (SELECT region_id, CASE WHEN p_value > 0 THEN p_value ELSE (SELECT min(p_value) FROM p WHERE p_value > 0) END AS p FROM p)", "r AS (SELECT *, row_number() OVER (ORDER BY p, region_id) AS k, count(*) OVER () AS n FROM q)", body="SELECT region_id, round(least(min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS fdr FROM r"))
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted p values."""
    return association.false_discovery(p_values(spark, sf_dir)).select("region_id", F.round("fdr", 6).alias("fdr"))


@query(with_sql(P_VALUES, body="SELECT p_partkey % 3 AS sim, count(*) AS n, count(*) FILTER (WHERE p_value <= 0.1) AS calls, count(*) FILTER (WHERE p_value <= 0.1 AND p_partkey % 4 = 0) AS true_positive, count(*) FILTER (WHERE p_value > 0.1 AND p_partkey % 4 <> 0) AS true_negative FROM p JOIN part ON p_partkey::VARCHAR = region_id GROUP BY 1"))
def power_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and truths by simulation."""
    return association.power_rates(p_values(spark, sf_dir).withColumn("fdr", F.col("p_value")), ("sim",)).select("sim", "n", "calls", "true_positive", "true_negative")


@query("SELECT n_inds, round(k * 5 / 100.0, 4) AS allele_freq, 1.5 AS effect, 'allele_freq' AS varied FROM (VALUES (10), (20), (30), (40), (50), (100)) AS t(n_inds), range(1, 11) AS r(k) UNION ALL SELECT n_inds, 0.2, round((100 + k * 20) / 100.0, 4), 'effect' FROM (VALUES (10), (20), (30), (40), (50), (100)) AS t(n_inds), range(0, 11) AS r(k)")
def power_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of power simulations."""
    g = simulate.power_grid(spark)
    return g.select("n_inds", F.round("allele_freq", 4).alias("allele_freq"), F.round("effect", 4).alias("effect"), "varied")


@query(with_sql(READS, body="SELECT qname, chrom, pos FROM reads ORDER BY md5(qname || '|7'), qname LIMIT 2000"))
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of reads (the operator samples)."""
    return views.reads(spark, sf_dir).orderBy(remap.hash_order("qname", seed=7), "qname").limit(2000).select("qname", "chrom", "pos")


@query(with_sql(*INPUT_BASE, """rows AS (SELECT g.chrom || ':' || g.pos::VARCHAR AS region_id, g.individual, (hap1 + hap2)::DOUBLE AS genotype, hap1::VARCHAR || '|' || hap2::VARCHAR AS haplotype FROM genotypes g),
sites AS (SELECT p.region_id, g.individual, count(DISTINCT s.pos)::INTEGER AS n_sites FROM parts p JOIN snps s ON s.chrom = p.chrom AND s.pos BETWEEN p.a AND p.z JOIN genotypes g ON g.chrom = s.chrom AND g.pos = s.pos AND g.hap1 <> g.hap2 GROUP BY ALL),
here AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY individual) AS n FROM rows),
there AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY md5(region_id || '|' || individual::VARCHAR || '|0'), individual) AS n FROM rows)""", body="SELECT h.region_id, h.individual, t.genotype, t.haplotype, s.n_sites FROM here h JOIN there t USING (region_id, n) LEFT JOIN sites s ON s.region_id = h.region_id AND s.individual = h.individual"))
def permute_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the combined test with genotypes dealt out anew."""
    return haplotypes.permuted(input_rows(spark, sf_dir)).select("region_id", "individual", "genotype", "haplotype", F.size("region_snps").alias("n_sites"))


def _simulated(spark: SparkSession) -> DataFrame:
    return simulate.simulate_counts(spark, effect=1.6, effect_share=0.5)


@query()
def simulate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated rows of the combined test."""
    return _simulated(spark).drop("region_snps")


@query()
def fit_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersion of each individual's allele counts."""
    return association.fit_allele_dispersion(input_rows(spark, sf_dir), sure=False)


@query()
def fit_bnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersion of each individual's depth."""
    return association.fit_depth_dispersion(input_rows(spark, sf_dir))


@query()
def depth_splines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth models of the individuals, fitted on the reads and GC content of all regions, and applied.

    Reads are counted once, for the fit and for what it is applied to: the rows are written.
    """
    sites = two_part_regions(spark, sf_dir)
    gc = regions.region_bases(sites, views.sequence(spark, sf_dir)).select("region_id", F.col("gc_fraction").alias("gc"))
    depth = counts.start_depth(usable(views.reads(spark, sf_dir)), by=("individual", "chrom", "pos"))
    rows = haplotypes.region_depth(sites, views.genotypes(spark, sf_dir), depth).withColumnRenamed("region_reads", "reads")
    made, path = association.with_totals(rows.join(gc, "region_id")), folder(spark, "depth")
    made.write.parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    return association.apply_depth_model(rows, association.fit_depth_model(rows)).select("region_id", "individual", "reads", "expected")


@query()
def cht_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined test of every region."""
    return association.combined_test(input_rows(spark, sf_dir))


@query()
def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of depth in regions."""
    return association.loadings(input_rows(spark, sf_dir), "region_reads", 3)


from . import counting, files, replays  # noqa: E402, F401  their queries are registered as well
