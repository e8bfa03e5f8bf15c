"""Queries that write a format's files from the derived tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import chrom as chroms
from ..sources import lines as line_source
from ..sources import fasta, impute, order, sam, streams, tables, vcf
from ..sources.scratch import folder
from . import views
from .queries import INPUT_BASE, NAMES, SITES_OF_ROWS, TARGET_BASE, input_rows, query, targets
from .views import GENOTYPES, ORDER_SEQUENCE, READS, SNPS, h, hashed, load, with_sql

CHROMS = [f"chr{i}" for i in range(1, 6)]


def put(lines: DataFrame, label: str, gzip: bool = True) -> str:
    """The folder that lines are written to."""
    path = folder(lines.sparkSession, label)
    tables.write_text(lines, path, gzip)
    return path


def by_chrom(lines: DataFrame, label: str) -> str:
    """Lines (chrom, value) in a folder for each chromosome."""
    path = folder(lines.sparkSession, label)
    lines.write.partitionBy("chrom").text(path)
    return path


@query("SELECT 'chr' || (n_nationkey + 1)::VARCHAR AS chrom, (1000 * n_nationkey + 7)::BIGINT AS length, true AS is_auto, (n_nationkey + 1)::INTEGER AS idnum FROM nation")
def chrom_info_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chromosome table written and read."""
    k = F.col("n_nationkey")
    lines = load(spark, sf_dir, "nation").select(F.concat_ws("\t", F.concat(F.lit("chr"), (k + 1).cast("string")), (1000 * k + 7).cast("string"), F.lit("x")).alias("value"))
    return chroms.read_chromosomes(spark, put(lines, "chrom-info")).select("chrom", "length", "is_auto", "idnum")


@query(with_sql(NAMES, body="SELECT chrom FROM names WHERE chrom NOT IN ('chrY', 'chrM', 'chr6_hap1', 'chrUn_random')"))
def chrom_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes of the classes chosen unless said otherwise: autosomes and X."""
    k = F.col("c_nationkey")
    name = F.when(k == 0, "chrX").when(k == 1, "chrY").when(k == 2, "chrM").when(k == 3, "chr6_hap1").when(k == 4, "chrUn_random").otherwise(F.concat(F.lit("chr"), k.cast("string")))
    return chroms.choose(chroms.classified(load(spark, sf_dir, "customer").select(name.alias("chrom")).distinct())).select("chrom")


@query("SELECT s_suppkey, CASE WHEN s_nationkey BETWEEN 1 AND 5 THEN 'chr' || s_nationkey::VARCHAR WHEN s_nationkey BETWEEN 10 AND 19 THEN 'chr1' WHEN s_nationkey BETWEEN 20 AND 24 THEN 'chr2' END AS chrom FROM supplier")
def chrom_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes guessed from names of files."""
    files = load(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("/data/chr"), F.col("s_nationkey").cast("string"), F.lit(".vcf.gz")).alias("path"))
    return chroms.guessed(files, views.chromosomes(spark)).select("s_suppkey", "chrom")


@query(with_sql(SNPS, body="SELECT chrom, pos, allele1, allele2 FROM snps"))
def snp_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of variants written and read, a folder for each chromosome."""
    path = folder(spark, "snps")
    tables.write_snps(views.snps(spark, sf_dir), path)
    out = [tables.read_snps(spark, f"{path}/chrom={c}", c) for c in CHROMS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


PL = ("0,10,20", "10,0,10", "20,10,0")
PROBS = ((1, 0.1, 0.01), (0.1, 1, 0.1), (0.01, 0.1, 1))


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VCF lines of all variants, a sample column for each nation."""
    g = views.genotypes(spark, sf_dir)
    sep = F.when(F.col("phased"), "|").otherwise("/")
    gt = F.when(F.col("hap1").isNull() | F.col("hap2").isNull(), "./.").otherwise(F.concat(F.col("hap1").cast("string"), sep, F.col("hap2").cast("string")))
    pl = F.get(F.array(*map(F.lit, PL)), (hashed("l", F.concat_ws("-", F.col("snp_idx").cast("string"), F.col("individual").cast("string"))) % 3).cast("int"))
    columns = g.groupBy("chrom", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("individual", F.concat_ws(":", gt, pl).alias("c")))), lambda x: x["c"]), "\t").alias("columns"))
    records = views.snps(spark, sf_dir).join(columns, ["chrom", "pos"]).select(F.concat_ws("\t", F.regexp_replace("chrom", "^chr", ""), F.col("pos").cast("string"), "name", "allele1", "allele2", F.lit("."), F.lit("."), F.lit("."), F.lit("GT:PL"), "columns").alias("value"))
    names = load(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\t").alias("n"))
    head = names.select(F.inline(F.array(F.struct(F.lit("##fileformat=VCFv4.2").alias("value")), F.struct(F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), "n").alias("value")))))
    return head.unionByName(records)


_LKEY = "(snp_idx::VARCHAR || '-' || individual::VARCHAR)"


@query(with_sql(SNPS, GENOTYPES, body=f"SELECT chrom, pos, sample, CASE WHEN hap2 IS NOT NULL THEN hap1 END::INTEGER AS hap1, CASE WHEN hap1 IS NOT NULL THEN hap2 END::INTEGER AS hap2, phased OR hap1 IS NULL OR hap2 IS NULL AS phased, round(CASE l WHEN 0 THEN 1 WHEN 1 THEN 0.1 ELSE 0.01 END / CASE l WHEN 1 THEN 1.2 ELSE 1.11 END, 4)::DOUBLE AS p_rr, round(CASE l WHEN 1 THEN 1 ELSE 0.1 END / CASE l WHEN 1 THEN 1.2 ELSE 1.11 END, 4)::DOUBLE AS p_ra FROM (SELECT *, {h('l', _LKEY)} % 3 AS l FROM genotypes) AS x"))
def vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A VCF file written and its genotypes read."""
    rows = vcf.read_genotypes(spark, put(vcf_lines(spark, sf_dir), "vcf"), views.chromosomes(spark))
    return rows.select("chrom", "pos", "sample", F.col("hap1").cast("int").alias("hap1"), F.col("hap2").cast("int").alias("hap2"), "phased", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("p_rr", "p_ra")))


@query(with_sql(SNPS, body="SELECT chrom, pos, name, allele1, allele2 FROM snps"))
def vcf_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A VCF file written and its variants read."""
    return vcf.read_variants(spark, put(vcf_lines(spark, sf_dir), "vcf"), views.chromosomes(spark)).select("chrom", "pos", "name", "allele1", "allele2")


@query("""SELECT p_partkey, round(a / s, 5) AS p_rr, round(b / s, 5) AS p_ra, round(c / s, 5) AS p_aa FROM (SELECT *, CASE WHEN k = 0 AND abs(a + b + c - 1) <= 0.001 THEN 1 ELSE a + b + c END AS s FROM (
  SELECT p_partkey, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN p_size / 100.0 WHEN 1 THEN pow(10.0, -p_size / 10.0) WHEN 2 THEN pow(10.0, -p_size / 10.0) END AS a,
    CASE p_partkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.1 WHEN 2 THEN 0.1 END AS b, CASE p_partkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.01 WHEN 2 THEN 0.01 END AS c FROM part) AS x) AS y""")
def vcf_probability_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype probabilities from GP, else GL, else PL, else none."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    fmt = F.when(k == 0, "GT:PL:GP").when(k == 1, "GL").when(k == 2, "GT:PL").otherwise("GT")
    value = F.when(k == 0, F.concat(F.lit("0|0:0,1,2:"), F.format_string("%.2f", size / 100.0), F.lit(",0.25,0.25"))).when(k == 1, F.concat(F.lit("-"), F.format_string("%.1f", size / 10.0), F.lit(",-1,-2"))).when(k == 2, F.concat(F.lit("0|1:"), size.cast("string"), F.lit(",10,20"))).otherwise("0|1")
    p = vcf.genotype_probabilities(fmt, value)
    return load(spark, sf_dir, "part").select("p_partkey", *(F.round(F.get(p, F.lit(i)), 5).alias(c) for i, c in enumerate(("p_rr", "p_ra", "p_aa"))))


_IKEY = "(g.snp_idx::VARCHAR || '-' || g.individual::VARCHAR)"


@query(with_sql(SNPS, GENOTYPES, body=f"SELECT g.chrom, g.pos, g.sample, round({h('t', _IKEY)} % 1000 / 1000.0, 3) AS p_ra, CASE WHEN g.pos % 3 > 0 THEN coalesce(g.hap1, 0) END::INTEGER AS hap1, CASE WHEN g.pos % 3 > 0 THEN coalesce(g.hap2, 0) END::INTEGER AS hap2 FROM genotypes g"))
def impute_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of probabilities and of haplotypes written for each chromosome, read and joined."""
    g = views.genotypes(spark, sf_dir).join(views.snps(spark, sf_dir).select("chrom", "pos", "name", "allele1", "allele2"), ["chrom", "pos"])
    names = [r[0] for r in load(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]  # a row per nation
    het = hashed("t", F.concat_ws("-", F.col("snp_idx").cast("string"), F.col("individual").cast("string"))) % 1000 / 1000.0

    def lines(rows: DataFrame, value) -> DataFrame:
        own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("individual", value.alias("v")))), lambda x: x["v"]), " ")
        at = rows.groupBy("chrom", "pos", "name", "allele1", "allele2").agg(own.alias("v"))
        return at.select("chrom", F.concat_ws(" ", F.lit("---"), "name", F.col("pos").cast("string"), "allele1", "allele2", "v").alias("value"))

    probs = by_chrom(lines(g, F.concat_ws(" ", F.format_string("%.3f", 1 - het), F.format_string("%.3f", het), F.lit("0"))), "impute")
    haps = by_chrom(lines(g.where("pos % 3 > 0"), F.concat_ws(" ", F.coalesce("hap1", F.lit(0)).cast("string"), F.coalesce("hap2", F.lit(0)).cast("string"))), "impute-haps")
    out = None
    for c, a, b in impute.paired_files([f"{probs}/chrom={c}" for c in CHROMS], [f"{haps}/chrom={c}" for c in CHROMS], CHROMS):
        one = impute.with_haplotypes(impute.read_probabilities(spark, a, names, c), impute.read_haplotypes(spark, b, names, c))
        out = one if out is None else out.unionByName(one)
    return out.select("chrom", "pos", "sample", F.round(F.col("p_ra").cast("double"), 3).alias("p_ra"), F.col("hap1").cast("int").alias("hap1"), F.col("hap2").cast("int").alias("hap2"))


@query("SELECT DISTINCT split_part(n_name, ' ', 1) AS name FROM nation")
def sample_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of samples written and read."""
    path = put(load(spark, sf_dir, "nation").select(F.concat(F.col("n_name"), F.lit(" more")).alias("value")), "samples")
    return spark.createDataFrame([(n,) for n in tables.read_names(spark, path, allow_repeats=True)], "name string")


@query(with_sql(ORDER_SEQUENCE, "whole AS (SELECT chrom, string_agg(bases, '' ORDER BY chunk_start) AS s FROM genome GROUP BY chrom)", body="SELECT chrom, (i * 1000 + 1)::BIGINT AS chunk_start, substr(s, (i * 1000 + 1)::INTEGER, 1000) AS bases FROM (SELECT chrom, s, unnest(range(0, (length(s) + 999) // 1000)) AS i FROM whole)"))
def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes, of bases by order, written as FASTA files and read in chunks of another length."""
    path = folder(spark, "fasta")
    chunks = views.order_sequence(spark, sf_dir)
    fasta.write_fasta(chunks, path)
    return fasta.read_fasta(spark, f"{path}/*", 1_000, chunks.groupBy("chrom").agg(F.sum(F.length("bases")).alias("length")))


@query(with_sql(ORDER_SEQUENCE, body="SELECT chrom, b AS base, count(*) AS n FROM (SELECT chrom, unnest(string_split(bases, '')) AS b FROM genome) AS x WHERE b <> '' GROUP BY ALL"))
def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each chromosome."""
    return fasta.composition(views.order_sequence(spark, sf_dir))


def sam_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reads(spark, sf_dir).select("qname", "flag", "chrom", "pos", "mapq", "cigar", F.when(F.col("pos") % 2 == 0, "=").otherwise("chr1").alias("rnext"), (F.col("pos") + 5).alias("mate_pos"), F.lit(37).alias("tlen"), "seq", F.lit("I" * 32).alias("qual"))


_MATE = "CASE WHEN pos % 2 = 0 THEN chrom ELSE 'chr1' END AS mate_chrom"


@query(with_sql(READS, body=f"SELECT qname, flag, chrom, pos, mapq, cigar, pos + 5 AS mate_pos, seq, {_MATE} FROM reads"))
def sam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as SAM and read."""
    head = spark.range(1).select(F.lit("@HD\tVN:1.6").alias("value"))
    return sam.read_sam(spark, put(head.unionByName(sam.sam_text(sam_reads(spark, sf_dir))), "sam")).select("qname", "flag", "chrom", "pos", "mapq", "cigar", "mate_pos", "seq", "mate_chrom")


@query(with_sql(READS, body="SELECT qname, pos FROM reads WHERE chrom = 'chr3'"))
def sam_chromosome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a chromosome that is named without chr."""
    return sam.on_chromosome(sam.read_sam(spark, put(sam.sam_text(sam_reads(spark, sf_dir)), "sam")), "3").select("qname", "pos")


@query(with_sql(READS, body="SELECT qname, '@' || qname || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', 32) AS first, '@' || qname || chr(10) || reverse(translate(seq, 'ACGT', 'TGCA')) || chr(10) || '+' || chr(10) || repeat('J', 32) AS second FROM reads"))
def fastq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ records of pairs; the second read is turned about."""
    v = views.reads(spark, sf_dir).select(F.col("qname").alias("name"), F.col("seq").alias("seq_a"), F.lit("I" * 32).alias("qual_a"), F.col("seq").alias("seq_b"), F.lit("J" * 32).alias("qual_b"))
    name = F.regexp_extract("value", "^@([^\n]*)", 1).alias("qname")
    a, b = tables.fastq_pair(v)
    return a.select(name, F.col("value").alias("first")).join(b.select(name, F.col("value").alias("second")), "qname")


_ALONG = "CASE cigar WHEN '32M' THEN 32 WHEN '10S22M' THEN 22 WHEN '10M50N22M' THEN 82 WHEN '12M2D20M' THEN 34 ELSE 29 END"


def sorted_bam(spark: SparkSession, sf_dir: str) -> str:
    """A folder of BAM files of all reads, sorted by place, in parts with an index each."""
    path = folder(spark, "bam")
    sam.write_bam(sam_reads(spark, sf_dir), path, views.chromosomes(spark).orderBy("chrom"))
    return path


@query(with_sql(SNPS, body="SELECT chrom, pos, name, allele1, allele2 FROM snps"))
def vcf_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants written as block gzip, read in splits of 4 KiB, and shown to be in order."""
    path = folder(spark, "vcf-blocks")
    s = views.snps(spark, sf_dir).repartitionByRange(3, "chrom", "pos").sortWithinPartitions("chrom", "pos")
    line_source.write_blocks(s.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "name", "allele1", "allele2", F.lit("."), F.lit("PASS"), F.lit(".")).alias("value")), path, header="##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")
    lines = line_source.block_lines(spark, path, split_bytes=4 << 10).where("NOT startswith(value, '#')")
    p = F.split("value", "\t")
    placed = lines.select("file", "start", p[0].alias("chrom"), p[1].cast("long").alias("pos"))
    order.checked(placed, F.col("file"), F.col("start")).collect()  # a row per file and chromosome, or an error
    return vcf.read_variants(spark, path, in_blocks=True)


@query(with_sql(READS, body=f"SELECT qname, flag, chrom, pos, mapq, cigar, pos + 5 AS mate_pos, 37::BIGINT AS tlen, seq, repeat('I', 32) AS qual, {_MATE} FROM reads"))
def bam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as sorted BAM parts and read in splits of 64 KiB."""
    return sam.read_bam(spark, sorted_bam(spark, sf_dir), split_bytes=1 << 16).drop("rnext")


@query(with_sql(READS, body=f"SELECT qname, chrom, pos, cigar FROM reads WHERE chrom = 'chr3' AND pos <= 9000 AND pos + {_ALONG} > 5001"))
def bam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that overlap a region, by the index of each part; the chromosome is named without chr."""
    return sam.read_bam(spark, sorted_bam(spark, sf_dir), region="3:5,001-9,000").select("qname", "chrom", "pos", "cigar")


@query(with_sql(READS, body="SELECT chrom, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, 0::BIGINT AS breaks FROM reads GROUP BY chrom"))
def bam_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of the order of sorted BAM parts, read in small splits, says of each chromosome."""
    return order.checked(sam.read_bam(spark, sorted_bam(spark, sf_dir), split_bytes=1 << 16)).select("chrom", "n", "first_pos", "last_pos", "breaks")


@query(with_sql(READS, body="SELECT 4 * count(*) AS lines, sum(length(seq))::BIGINT AS bases FROM reads"))
def fastq_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ records written, and read as lines whatever the files are called."""
    v = views.reads(spark, sf_dir).select(F.col("qname").alias("name"), "seq", F.lit("I" * 32).alias("qual"))
    lines = streams.read_lines(spark, put(tables.fastq_single(v), "fastq"))
    return lines.agg(F.count("*").alias("lines"), F.sum(F.when(F.col("line") % 4 == 2, F.length("value"))).alias("bases"))


@query(with_sql(READS, body="SELECT count(*) AS lines FROM reads"))
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files, gzip or not."""
    r = views.reads(spark, sf_dir).select(F.col("qname").alias("value"), "pos")
    a, b = put(r.where("pos % 2 = 0"), "lines"), put(r.where("pos % 2 = 1"), "lines", gzip=False)
    return streams.count_lines(spark, [a, b]).agg(F.sum("lines").alias("lines"))


@query(with_sql(*TARGET_BASE, body="SELECT chrom || ':' || pos::VARCHAR || ':' || name AS region_id, chrom, pos AS test_pos, ref, alt, start::VARCHAR AS starts, stop::VARCHAR AS stops FROM targets"))
def region_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target regions written and read."""
    rows = tables.read_regions(spark, put(tables.region_text(targets(spark, sf_dir)), "regions"))
    return rows.select("region_id", "chrom", "test_pos", "ref", "alt", F.array_join("starts", ";").alias("starts"), F.array_join("stops", ";").alias("stops"))


@query(with_sql(*INPUT_BASE, SITES_OF_ROWS, body="SELECT individual::VARCHAR AS individual, chrom, test_pos, test_id, genotype, haplotype, n_sites, coalesce(as_n, 0) AS as_n, region_reads, genome_reads FROM text_rows"))
def cht_input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the combined test written to a file for each individual, and read."""
    rows = input_rows(spark, sf_dir)
    path = folder(spark, "cht")
    lines = tables.input_text(rows, keep=["individual"])
    lines.write.partitionBy("individual").text(path, compression="gzip")
    got = tables.read_input(spark, {str(i): f"{path}/individual={i}" for i in range(25)})
    total = F.coalesce(F.aggregate("region_snps", F.lit(0).cast("long"), lambda s, x: s + x["ref_n"] + x["alt_n"]), F.lit(0).cast("long"))
    return got.select("individual", "chrom", "test_pos", "test_id", "genotype", "haplotype", F.when(F.col("region_snps").isNotNull(), F.size("region_snps").cast("long")).alias("n_sites"), total.alias("as_n"), "region_reads", "genome_reads")


@query(with_sql(*INPUT_BASE, SITES_OF_ROWS, body="SELECT individual::VARCHAR AS individual, row_number() OVER (PARTITION BY individual ORDER BY chrom, test_pos) - 1 AS \"row\", chrom, test_pos, test_id FROM text_rows"))
def cht_input_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the combined test written in one order for each individual, read line by line together."""
    path = folder(spark, "cht-in-order")
    rows = tables.input_text(input_rows(spark, sf_dir), keep=["individual", "chrom", "test_pos", "region_id"])
    parts = rows.repartitionByRange(4, "chrom", "test_pos", "region_id").sortWithinPartitions("individual", "chrom", "test_pos", "region_id")
    parts.select("individual", "value").write.partitionBy("individual").text(path)
    return tables.read_aligned_input(spark, {str(i): f"{path}/individual={i}" for i in range(25)}).select("individual", "row", "chrom", "test_pos", "test_id")


@query("SELECT n_name AS individual, n_nationkey / 10.0 + 0.05 AS disp, n_nationkey + 0.5 AS c1, n_nationkey * 2.0 AS c2 FROM nation")
def individual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersions, coefficients and covariates of individuals written and read."""
    k = F.col("n_nationkey")
    own = load(spark, sf_dir, "nation").select(F.col("n_name").alias("individual"), (k / 10.0 + 0.05).alias("disp"), F.array(k + 0.5, k * 2.0).alias("coefs"))
    names = [r[0] for r in own.orderBy("individual").select("individual").collect()]  # a row per nation
    a, b, c = (folder(spark, x) for x in ("values", "coefs", "covariates"))
    tables.write_values(own, a)
    tables.write_coefficients(own, b)
    tables.write_coefficients(own.withColumn("coefs", F.concat("coefs", F.array(F.lit(9.0)))), c)
    both = tables.read_values(spark, a, names, 0.0, 10.0).join(tables.read_coefficients(spark, b, names), "individual").join(tables.read_covariates(spark, c, names, 2), "individual")
    return both.select("individual", "disp", F.get("coefs", F.lit(0)).alias("c1"), F.get("values", F.lit(1)).alias("c2"))


@query(with_sql(SNPS, GENOTYPES, body="SELECT s.pos, s.allele1 AS ref, s.allele2 AS alt, coalesce(g.hap1, 0)::INTEGER AS hap1, coalesce(g.hap2, 0)::INTEGER AS hap2 FROM snps s JOIN genotypes g ON g.chrom = s.chrom AND g.pos = s.pos AND g.individual = 1 WHERE s.chrom = 'chr2' AND length(s.allele2) = 1"))
def haplotype_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulator's list of one individual's haplotypes on a chromosome written and read."""
    g = views.genotypes(spark, sf_dir).where("individual = 1 AND chrom = 'chr2'").join(views.snps(spark, sf_dir).select("chrom", "pos", "allele1", "allele2"), ["chrom", "pos"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return tables.read_haplotype_list(spark, put(g.select(F.concat_ws(" ", F.col("pos").cast("string"), "allele1", "allele2", z("hap1"), z("hap2")).alias("value")), "haplotypes"))
