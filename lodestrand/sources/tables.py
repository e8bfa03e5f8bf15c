"""Smaller text formats: variant lists, samples, regions, rows and results of the combined test, FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import reverse_complement
from .lines import numbered, text_lines

REGION_COLUMNS = ("chrom", "pos", "end_pos", "ref", "alt", "strand", "name", "starts", "stops")
INPUT_COLUMNS = ("CHROM", "TEST.SNP.POS", "TEST.SNP.ID", "TEST.SNP.REF.ALLELE", "TEST.SNP.ALT.ALLELE", "TEST.SNP.GENOTYPE", "TEST.SNP.HAPLOTYPE", "REGION.START", "REGION.END", "REGION.SNP.POS", "REGION.SNP.HET.PROB", "REGION.SNP.LINKAGE.PROB", "REGION.SNP.REF.HAP.COUNT", "REGION.SNP.ALT.HAP.COUNT", "REGION.SNP.OTHER.HAP.COUNT", "REGION.READ.COUNT", "GENOMEWIDE.READ.COUNT")


def _fields(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"), F.input_file_name().alias("file"))


def _na(c: Column) -> Column:
    return F.when(c != "NA", c)


def _formatted(form: str, c: Column) -> Column:
    """A number as text, or NA."""
    return F.when(c.isNotNull(), F.format_string(form, c)).otherwise("NA")


def read_snps(spark: SparkSession, paths: str | list[str], chrom: str | None = None) -> DataFrame:
    """chrom, pos, allele1, allele2 of files with pos and two alleles a line, named by chromosome; alleles in upper case, - left out."""
    named = F.lit(chrom) if chrom else F.regexp_extract("file", r"([^/]+?)\.snps\.txt(\.gz)?$", 1)
    p = F.col("p")
    pos = p[0].cast("long")
    checked = F.when((F.size(p) >= 3) & (pos > 0), pos).otherwise(F.raise_error(F.concat(F.lit("not a variant: "), F.array_join(p, " "))).cast("long"))
    clean = lambda c: F.translate(F.upper(c), "-", "")
    return _fields(spark, paths).select(named.alias("chrom"), checked.alias("pos"), clean(p[1]).alias("allele1"), clean(p[2]).alias("allele2"))


def write_snps(snps: DataFrame, path: str) -> None:
    """pos and alleles as text, a folder for each chromosome."""
    line = F.concat_ws(" ", F.col("pos").cast("string"), F.when(F.col("allele1") == "", "-").otherwise(F.col("allele1")), F.when(F.col("allele2") == "", "-").otherwise(F.col("allele2")))
    snps.select("chrom", line.alias("value")).write.partitionBy("chrom").text(path, compression="gzip")


def read_names(spark: SparkSession, path: str, allow_repeats: bool = False) -> list[str]:
    """First words of the lines of a list; a repeated one is an error unless allowed."""
    names = [r.p[0] for r in _fields(spark, path).select("p").collect()]  # a list of samples is small
    if not allow_repeats and len(set(names)) < len(names):
        raise ValueError("a name is repeated")
    return list(dict.fromkeys(names))


def sample_names(genotypes: DataFrame) -> DataFrame:
    return genotypes.select("chrom", "sample").distinct()


def read_values(spark: SparkSession, path: str, names: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """individual and disp from a number a line, in the order of names; the numbers must be as many, and within bounds."""
    values = [float(r.p[0]) for r in _fields(spark, path).select("p").collect()]  # a line per individual
    if len(values) != len(names):
        raise ValueError(f"{len(values)} values for {len(names)} individuals")
    if any(low is not None and v < low or high is not None and v > high for v in values):
        raise ValueError("a value is out of bounds")
    return spark.createDataFrame(list(zip(names, values, strict=True)), "individual string, disp double")


def write_values(values: DataFrame, path: str, column: str = "disp") -> None:
    """A value a line, by individual."""
    values.orderBy("individual").select(F.col(column).cast("string").alias("value")).coalesce(1).write.text(path)


def write_coefficients(coefs: DataFrame, path: str) -> None:
    """A line of tab-separated coefficients (an array, coefs) for each individual, in their order."""
    coefs.orderBy("individual").select(F.array_join(F.transform("coefs", lambda c: c.cast("string")), "\t").alias("value")).coalesce(1).write.text(path)


def read_coefficients(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """individual and coefs from a line of numbers for each, in the order of names; the lines must be as many."""
    rows = [[float(x) for x in r.p] for r in _fields(spark, path).select("p").collect()]  # a line per individual
    if len(rows) != len(names):
        raise ValueError(f"{len(rows)} lines for {len(names)} individuals")
    return spark.createDataFrame(list(zip(names, rows, strict=True)), "individual string, coefs array<double>")


def read_covariates(spark: SparkSession, path: str, names: list[str], count: int) -> DataFrame:
    """individual and values (the first count covariates) from a matrix with a line per individual."""
    rows = [[float(x) for x in r.p[:count]] for r in _fields(spark, path).select("p").collect()]  # a line per individual
    if len(rows) != len(names):
        raise ValueError(f"{len(rows)} lines for {len(names)} individuals")
    return spark.createDataFrame(list(zip(names, rows, strict=True)), "individual string, values array<double>")


def read_haplotype_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, ref, alt, hap1, hap2 of variants that are one base for another."""
    p = F.col("p")
    rows = _fields(spark, path).select(p[0].cast("long").alias("pos"), p[1].alias("ref"), p[2].alias("alt"), p[3].cast("int").alias("hap1"), p[4].cast("int").alias("hap2"))
    return rows.where("length(ref) = 1 AND length(alt) = 1 AND ref <> '-' AND alt <> '-'")


def region_text(regions: DataFrame) -> DataFrame:
    """value: the nine columns of a target region."""
    r = lambda c: F.col(c).cast("string")
    return regions.select(F.concat_ws(" ", r("chrom"), r("pos"), r("end_pos"), r("ref"), r("alt"), F.lit("+"), r("name"), r("start"), r("stop")).alias("value"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """region_id, chrom, test_pos, ref, alt, starts, stops."""
    p = F.col("p")
    longs = lambda c: F.split(c, ";").cast("array<bigint>")
    return _fields(spark, path).select(F.concat_ws(":", p[0], p[1], p[6]).alias("region_id"), p[0].alias("chrom"), p[1].cast("long").alias("test_pos"), p[3].alias("ref"), p[4].alias("alt"), longs(p[7]).alias("starts"), longs(p[8]).alias("stops"))


def input_text(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """value: the seventeen columns of a row of the combined test; what is null is NA.  keep: columns that come along."""
    r = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    joined = lambda f, fmt=None: F.when(F.size("region_snps") > 0, F.array_join(F.transform("region_snps", lambda s: F.format_string(fmt, s[f]) if fmt else s[f].cast("string")), ";")).otherwise("NA")
    parts = [r("chrom"), r("test_pos"), r("test_id"), r("ref"), r("alt"), _formatted("%.2f", F.col("genotype")), r("haplotype"), F.array_join("starts", ";"), F.array_join("stops", ";"), joined("pos"), joined("het_prob", "%.2f"), joined("linkage", "%.2f"), joined("ref_n"), joined("alt_n"), joined("other_n"), r("region_reads"), _formatted("%.2f", F.col("genome_reads").cast("double"))]
    return rows.select(*(keep or []), F.concat_ws(" ", *parts).alias("value"))


def _of_individuals(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """individual, file, start, i and value of the lines of all files, in one scan; a path may be a folder."""
    if not files:
        raise ValueError("no file is named")
    sc = spark.sparkContext

    def plain(path: str) -> str:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath()

    names = spark.createDataFrame([(plain(path), name) for name, path in files.items()], "_at string, individual string")  # a row per individual
    lines = text_lines(spark, list(files.values()))
    # a file lies at one of the paths, or in a folder that is one of them
    path = F.url_decode(F.regexp_replace(F.regexp_replace("file", "^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), r"\+", "%2B"))
    found = lines.select("file").distinct().withColumn("_parts", F.split(path, "/"))
    above = found.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.array_join(F.slice("_parts", F.lit(1), n), "/"))).alias("_at"))
    own = above.join(F.broadcast(names), "_at").select("file", "individual")
    return lines.join(F.broadcast(own), "file")  # a row per file


def read_input(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Rows of the combined test from a file (or folder) for each individual, in one scan of all; NA is null, and rows with a header's first word are passed over."""
    return _input_rows(_of_individuals(spark, files))


def _input_rows(lines: DataFrame, *more: str) -> DataFrame:
    p = F.col("p")
    at = lambda i: _na(F.get(p, F.lit(i)))
    lists = [F.split(at(i), ";") for i in range(9, 15)]
    names = (("pos", "bigint"), ("het_prob", "double"), ("linkage", "double"), ("ref_n", "bigint"), ("alt_n", "bigint"), ("other_n", "bigint"))
    snps = F.when(at(9).isNotNull(), F.transform(F.arrays_zip(*(x.alias(f"c{i}") for i, x in enumerate(lists))), lambda z: F.struct(*(z[f"c{i}"].cast(kind).alias(name) for i, (name, kind) in enumerate(names)))))
    return lines.where("trim(value) <> ''").withColumn("p", F.split(F.trim("value"), r"\s+")).where("p[0] <> 'CHROM'").select(
        F.concat_ws(":", p[0], p[1], F.get(p, F.lit(7)), F.get(p, F.lit(8))).alias("region_id"), p[0].alias("chrom"), p[1].cast("long").alias("test_pos"), at(2).alias("test_id"), at(3).alias("ref"), at(4).alias("alt"), at(5).cast("double").alias("genotype"), at(6).alias("haplotype"),
        F.split(at(7), ";").cast("array<bigint>").alias("starts"), F.split(at(8), ";").cast("array<bigint>").alias("stops"), snps.alias("region_snps"), at(15).cast("long").alias("region_reads"), at(16).cast("double").alias("genome_reads"), "individual", *more,
    )


def read_aligned_input(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """read_input() with row, the number of a line in its individual's file, from 0 (a header counts).

    Line by line, all individuals must have the same test: one that another
    lacks, or has elsewhere, is an error that names the row.
    """
    rows = _input_rows(numbered(_of_individuals(spark, files), by=("individual",)).withColumnRenamed("line", "row"), "row")
    each = rows.groupBy("row").agg(F.count("*").alias("n"), F.min("region_id").alias("low"), F.max("region_id").alias("high"))
    bad = each.where((F.col("n") != len(files)) | (F.col("low") != F.col("high"))).orderBy("row").limit(1).collect()
    if bad:
        r = bad[0]
        raise ValueError(f"row {r.row}: {r.n} of {len(files)} individuals have a test there" if r.low == r.high else f"row {r.row}: {r.low} for one individual, {r.high} for another")
    return rows


def result_text(results: DataFrame) -> DataFrame:
    """value: a tab-separated line for each result."""
    f = lambda c, fmt: _formatted(fmt, F.col(c))
    return results.select(F.concat_ws("\t", "chrom", F.col("test_pos").cast("string"), "region_id", f("loglik_null", "%.2f"), f("loglik_alt", "%.2f"), f("chi_square", "%.3f"), f("p_value", "%g"), f("alpha", "%g"), f("beta", "%g"), f("dispersion", "%g"), *(F.col(c).cast("string") for c in ("as_ref", "as_alt", "as_reads", "all_reads", "n_individuals"))).alias("value"))


def fastq_single(versions: DataFrame) -> DataFrame:
    """value: a FASTQ record (four lines) for each version: name, seq, qual."""
    return versions.select(F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual")).alias("value"))


def fastq_pair(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FASTQ records of first and second reads (seq_a, qual_a, seq_b, qual_b); the second one's bases are turned about, its quality is not."""
    second = versions.withColumn("seq_b", reverse_complement(F.col("seq_b")))
    return tuple(fastq_single(v.select("name", F.col(f"seq_{s}").alias("seq"), F.col(f"qual_{s}").alias("qual"))) for v, s in ((versions, "a"), (second, "b")))  # type: ignore[return-value]


def write_text(lines: DataFrame, path: str, gzip: bool = True) -> None:
    lines.select("value").write.text(path, compression="gzip" if gzip else "none")
