"""Read, variant and genotype tables derived from the test tables, without a choice of rows.

Each exists as a DataFrame and as SQL of the same meaning (for comparison with
another engine).  H(x) is the number that the first six hex digits of md5(x) write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts

CIGARS = ("32M", "10S22M", "10M50N22M", "12M2D20M", "12M3I17M")
SPACE = 20_000


def hashed(prefix: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(prefix), key.cast("string"))), 1, 6), 16, 10).cast("long")


def letters(key: Column) -> Column:
    return F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


def base_of(prefix: str, key: Column) -> Column:
    return F.substring(letters(F.concat(F.lit(prefix), key.cast("string"))), 1, 1)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reads, one per order: qname, individual, flag, chrom, pos, mapq, cigar, seq."""
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kind = hashed("f", key) % 20
    flag = F.when(kind == 0, 4).when(kind == 1, 256).when(kind == 2, 2048).when(kind % 2 == 0, 16).otherwise(0)
    return o.select(
        F.concat(F.lit("r"), key.cast("string")).alias("qname"),
        (F.col("o_custkey") % 25).cast("long").alias("individual"),
        flag.cast("int").alias("flag"),
        F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chrom"),
        (hashed("p", key) % SPACE + 1).alias("pos"),
        (hashed("q", key) % 60).cast("int").alias("mapq"),
        F.get(F.array(*map(F.lit, CIGARS)), (hashed("c", key) % len(CIGARS)).cast("int")).alias("cigar"),
        letters(key).alias("seq"),
    )


def h(p: str, k: str) -> str:
    return f"('0x' || substr(md5('{p}' || {k}::VARCHAR), 1, 6))::BIGINT"


def sql_letters(k: str) -> str:
    return f"translate(md5({k}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


_CIGAR_SQL = "CASE " + h("c", "o_orderkey") + f" % {len(CIGARS)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CIGARS)) + " END"

READS = f"""reads AS (
  SELECT 'r' || o_orderkey::VARCHAR AS qname, (o_custkey % 25)::BIGINT AS individual,
    (CASE WHEN k = 0 THEN 4 WHEN k = 1 THEN 256 WHEN k = 2 THEN 2048 WHEN k % 2 = 0 THEN 16 ELSE 0 END)::INTEGER AS flag,
    'chr' || (o_custkey % 5 + 1)::VARCHAR AS chrom, {h("p", "o_orderkey")} % {SPACE} + 1 AS pos,
    ({h("q", "o_orderkey")} % 60)::INTEGER AS mapq, {_CIGAR_SQL} AS cigar,
    {sql_letters("o_orderkey::VARCHAR")} AS seq
  FROM (SELECT *, {h("f", "o_orderkey")} % 20 AS k FROM orders) AS o)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired reads, mates from orders 2k and 2k+1: qname, mate, flag, chrom, pos, mate_pos, cigar, seq."""
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    qname = F.floor(key / 2).cast("long")
    place = lambda mate: hashed("p", qname) % 500 + 1 + mate * (hashed("d", qname * 2 + mate) % 40)
    mate = (key % 2).cast("long")
    other = 1 - mate
    kind = hashed("g", key) % 40
    flag = F.lit(1) + F.when(kind == 0, 4).otherwise(0) + F.when(kind == 1, 8).otherwise(0) + F.when(kind == 2, 0).otherwise(2) + F.when(kind == 3, 256).otherwise(0) + F.when(kind == 4, 2048).otherwise(0) + F.when(mate == 0, 64).otherwise(128)
    return o.select(qname.alias("qname"), mate.alias("mate"), flag.cast("int").alias("flag"), F.concat(F.lit("chr"), (qname % 5 + 1).cast("string")).alias("chrom"), F.when(kind == 5, F.concat(F.lit("chr"), ((qname + 1) % 5 + 1).cast("string"))).otherwise(F.concat(F.lit("chr"), (qname % 5 + 1).cast("string"))).alias("mate_chrom"), place(mate).alias("pos"), place(other).alias("mate_pos"), F.lit("32M").alias("cigar"), letters(key).alias("seq"))


def _place_sql(mate: str) -> str:
    return f"({h('p', 'qname')} % 500 + 1 + ({mate}) * ({h('d', f'(qname * 2 + ({mate}))')} % 40))"


PAIRS = f"""pairs AS (
  SELECT qname, mate,
    (1 + CASE WHEN kind = 0 THEN 4 ELSE 0 END + CASE WHEN kind = 1 THEN 8 ELSE 0 END + CASE WHEN kind = 2 THEN 0 ELSE 2 END + CASE WHEN kind = 3 THEN 256 ELSE 0 END + CASE WHEN kind = 4 THEN 2048 ELSE 0 END + CASE WHEN mate = 0 THEN 64 ELSE 128 END)::INTEGER AS flag,
    'chr' || (qname % 5 + 1)::VARCHAR AS chrom,
    'chr' || (CASE WHEN kind = 5 THEN (qname + 1) % 5 + 1 ELSE qname % 5 + 1 END)::VARCHAR AS mate_chrom,
    {_place_sql("mate")} AS pos, {_place_sql("1 - mate")} AS mate_pos, '32M' AS cigar, seq
  FROM (SELECT o_orderkey // 2 AS qname, o_orderkey % 2 AS mate, {h("g", "o_orderkey")} % 40 AS kind, {sql_letters("o_orderkey::VARCHAR")} AS seq FROM orders) AS o)"""


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants, one per part: chrom, snp_idx, name, pos, allele1, allele2; of several at a position the last stays.

    A tenth are insertions.
    """
    p = load(spark, sf_dir, "part")
    key = F.col("p_partkey")
    ref, alt = base_of("r", key), base_of("a", key)
    alt = F.when(alt == ref, F.translate(alt, "ACGT", "CGTA")).otherwise(alt)
    alt = F.when(hashed("i", key) % 10 == 0, F.concat(ref, F.lit("TT"))).otherwise(alt)
    rows = p.select(F.concat(F.lit("chr"), (key % 5 + 1).cast("string")).alias("chrom"), key.cast("long").alias("snp_idx"), F.concat(F.lit("rs"), key.cast("string")).alias("name"), (hashed("s", key) % SPACE + 1).alias("pos"), ref.alias("allele1"), alt.alias("allele2"))
    return counts.last_per_position(rows)


SNPS = f"""snps AS (
  SELECT chrom, snp_idx, name, pos, allele1, CASE WHEN ins THEN allele1 || 'TT' WHEN a = allele1 THEN translate(a, 'ACGT', 'CGTA') ELSE a END AS allele2
  FROM (SELECT 'chr' || (p_partkey % 5 + 1)::VARCHAR AS chrom, p_partkey::BIGINT AS snp_idx, 'rs' || p_partkey::VARCHAR AS name, {h("s", "p_partkey")} % {SPACE} + 1 AS pos,
      substr({sql_letters("'r' || p_partkey::VARCHAR")}, 1, 1) AS allele1, substr({sql_letters("'a' || p_partkey::VARCHAR")}, 1, 1) AS a, {h("i", "p_partkey")} % 10 = 0 AS ins FROM part) AS x
  QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY snp_idx DESC) = 1)"""


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes of each nation at each variant: chrom, pos, sample, hap1, hap2, phased; an allele may be missing."""
    s = snps(spark, sf_dir)
    n = F.broadcast(load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("individual"), F.col("n_name").alias("sample")))  # a fixed list of nations
    key = F.concat(F.col("snp_idx").cast("string"), F.lit("-"), F.col("individual").cast("string"))
    hap = lambda p: F.when(hashed("m" + p, key) % 50 == 0, F.lit(None)).otherwise(hashed(p, key) % 2).cast("long")
    each = s.withColumn("individual", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))))
    return each.join(n, "individual").select("chrom", "pos", "snp_idx", "individual", "sample", hap("x").alias("hap1"), hap("y").alias("hap2"), (hashed("z", key) % 3 > 0).alias("phased"))


_GKEY = "(snp_idx::VARCHAR || '-' || n_nationkey::VARCHAR)"
GENOTYPES = f"""genotypes AS (
  SELECT chrom, pos, snp_idx, n_nationkey::BIGINT AS individual, n_name AS sample,
    CASE WHEN {h("mx", _GKEY)} % 50 = 0 THEN NULL ELSE {h("x", _GKEY)} % 2 END AS hap1,
    CASE WHEN {h("my", _GKEY)} % 50 = 0 THEN NULL ELSE {h("y", _GKEY)} % 2 END AS hap2,
    {h("z", _GKEY)} % 3 > 0 AS phased
  FROM snps CROSS JOIN nation)"""


def chromosomes(spark: SparkSession) -> DataFrame:
    """The five chromosomes of the derived tables."""
    return spark.range(1, 6).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.lit(SPACE + 1000).cast("long").alias("length"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosome sequence in chunks of 32 bases, each written by the md5 of its place: chrom, chunk_start, bases."""
    at = F.concat_ws("-", F.lit("g"), F.col("chrom"), F.col("chunk").cast("string"))
    return chromosomes(spark).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / 32).cast("int")))).select("chrom", (F.col("chunk") * 32 + 1).cast("long").alias("chunk_start"), letters(at).alias("bases"))


SEQUENCE = f"""genome AS (
  SELECT chrom, chunk * 32 + 1 AS chunk_start, {sql_letters("'g-' || chrom || '-' || chunk::VARCHAR")} AS bases
  FROM (SELECT 'chr' || c::VARCHAR AS chrom, unnest(range(0, {(SPACE + 999) // 32 + 1})) AS chunk FROM range(1, 6) AS t(c)) AS x)"""


def order_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes that grow with the orders, each of which gives 32 bases: chrom, chunk_start, bases."""
    key = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(F.concat(F.lit("chr"), (key % 5 + 1).cast("string")).alias("chrom"), (F.floor(key / 5) * 32 + 1).cast("long").alias("chunk_start"), letters(key).alias("bases"))


ORDER_SEQUENCE = f"""genome AS (SELECT 'chr' || (o_orderkey % 5 + 1)::VARCHAR AS chrom, (o_orderkey // 5 * 32 + 1)::BIGINT AS chunk_start, {sql_letters("o_orderkey::VARCHAR")} AS bases FROM orders)"""

#: The CIGAR walk in SQL: blocks of aligned bases.
BLOCKS = r"""ops AS (
  SELECT qname, individual, flag, chrom, pos, seq, cigar, unnest(regexp_extract_all(cigar, '(\d+)[MIDNSHP=X]', 1))::BIGINT AS n, unnest(regexp_extract_all(cigar, '\d+([MIDNSHP=X])', 1)) AS op, generate_subscripts(regexp_extract_all(cigar, '\d+[MIDNSHP=X]'), 1) AS i
  FROM reads),
blocks AS (
  SELECT qname, individual, flag, chrom, seq, cigar, op, n,
    pos + coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS g_start,
    1 + coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS r_start
  FROM ops WINDOW w AS (PARTITION BY qname ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hits AS (
  SELECT b.qname, b.individual, b.flag, b.chrom, b.seq, b.op, s.pos, s.allele1, s.allele2, s.snp_idx, b.r_start + s.pos - b.g_start AS read_pos,
    regexp_matches(s.allele1, '^[ACGT]$') AND regexp_matches(s.allele2, '^[ACGT]$') AS is_snp, substr(b.seq, (b.r_start + s.pos - b.g_start)::INTEGER, 1) AS base
  FROM blocks b JOIN snps s ON s.chrom = b.chrom AND s.pos BETWEEN b.g_start AND b.g_start + b.n - 1
  WHERE b.op IN ('M','=','X') OR (b.op = 'D' AND NOT (regexp_matches(s.allele1, '^[ACGT]$') AND regexp_matches(s.allele2, '^[ACGT]$'))))"""


def with_sql(*parts: str, body: str) -> str:
    """A statement over some of the tables above."""
    return "WITH " + ",\n".join(parts) + "\n" + body

