"""FASTA, SAM text and annotation files as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default header pattern and its groups for feature and group.
HEADER = r"(\S+).*gene:(\S+).*"
GTF = "chrom string, source string, feature string, start int, end int, score string, strand string, frame string, attributes string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, seq: the letters of a record's lines; records start at > in column one."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    return raw.filter(F.length(F.trim("value")) > 0).select(
        F.regexp_replace(F.substring_index(body, "\n", 1), "\r$", "").alias("header"),
        F.regexp_replace(F.regexp_replace(body, r"^[^\n]*(\n|$)", ""), "[^A-Za-z]", "").alias("seq"),
    )


def header_ids(df: DataFrame, pattern: str = HEADER, feature: int = 1, group: int = 2, header: str = "header") -> DataFrame:
    """Adds transcript and gene by a pattern that must match the whole header; others raise an error when used."""
    whole = f"^(?:{pattern})$"
    fail = F.raise_error(F.concat(F.lit("header does not match: "), F.col(header))).cast("string")
    part = lambda g: F.when(F.col(header).rlike(whole), F.regexp_extract(header, whole, g)).otherwise(fail)
    return df.withColumns({"transcript": part(feature), "gene": part(group)})


def features_of(fasta: DataFrame, merge_haplotypes: bool = False) -> DataFrame:
    """transcript, gene, seq, true_length, effective_length (at first the length)."""
    f = fasta.select("transcript", "gene", "seq", F.length("seq").alias("true_length"), F.length("seq").cast("double").alias("effective_length"))
    if merge_haplotypes:
        f = f.filter(~F.col("transcript").endswith("_B")).withColumn("transcript", strip_haplotype(F.col("transcript")))
    return f


def strip_haplotype(c: Column) -> Column:
    return F.regexp_replace(c, "_[AB]$", "")


def grep_entries(fasta: DataFrame, pattern: str, invert: bool = False) -> DataFrame:
    hit = F.col("header").rlike(pattern)
    return fasta.filter(~hit if invert else hit)


def wrapped(seq: Column, width: int = 60) -> Column:
    """A sequence in lines of `width`, without a blank last line."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), wrapped(F.col("seq"))).alias("value")).write.mode("overwrite").text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: qname, flag, rname, pos, mpos, isize (absolute), tlen, nm (0 if there is no tag), read_length, ordinal.

    ordinal puts alignments in the order of the input: file, the start of the piece of it that a task reads, the line in the task.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("line"))
    line = spark.read.text(path).select("value", place.alias("ordinal")).filter(~F.col("value").startswith("@"))
    c = F.split("value", "\t")
    nm = F.regexp_extract("value", r"\tNM:i:(\d+)", 1)
    return line.select(
        c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("rname"), c[3].cast("int").alias("pos"),
        c[7].cast("int").alias("mpos"), c[8].cast("int").alias("tlen"), F.abs(c[8].cast("int")).alias("isize"),
        F.when(nm == "", 0).otherwise(nm.cast("int")).alias("nm"), F.when(c[9] == "*", 0).otherwise(F.length(c[9])).alias("read_length"), "ordinal",
    )


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """Names of the @SQ header lines."""
    head = spark.read.text(path).filter(F.col("value").startswith("@SQ"))
    return head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("rname"))


def sort_order(spark: SparkSession, path: str) -> str | None:
    """The sort order that the @HD line names."""
    return order_of(spark.read.text(path))


def order_of(lines: DataFrame) -> str | None:
    head = lines.filter(F.col("value").startswith("@HD") & F.col("value").contains("\tSO:")).first()
    return head["value"].split("\tSO:")[1].split("\t")[0] if head else None


def chromosomes_of(fasta: DataFrame) -> DataFrame:
    """chrom, seq, first, last (1-based): the first word of a header, and the range that chromosome:...:first:last names."""
    place = F.split(F.regexp_extract("header", r"(?:^|\s)(\S*chromosome:\S*)", 1), ":")
    bound = lambda i: F.get(place, F.lit(i)).cast("int")
    name = F.regexp_extract("header", r"^(\S*)", 1)
    return fasta.select(name.alias("chrom"), "seq", F.coalesce(bound(3), F.lit(1)).alias("first"), F.coalesce(bound(4), F.length("seq")).alias("last"))


def unknown_references(names: DataFrame, features: DataFrame) -> DataFrame:
    """References that no feature has; a run must have none."""
    return names.join(features.select(F.col("transcript").alias("rname")), "rname", "left_anti")


def read_gtf(spark: SparkSession, path: str, feature: str | None = "exon") -> DataFrame:
    """GTF rows with transcript_id and gene_id; start and end stay 1-based and inclusive."""
    g = spark.read.csv(path, sep="\t", comment="#", schema=GTF, quote="")
    g = g.filter(F.col("feature") == feature) if feature else g
    return g.withColumns({k: F.regexp_extract("attributes", rf'{k} "([^"]*)"', 1) for k in ("transcript_id", "gene_id")})


def comments(spark: SparkSession, path: str) -> DataFrame:
    """The lines that begin with #."""
    return spark.read.text(path).filter(F.col("value").startswith("#"))


def write_gtf(df: DataFrame, path: str, head: DataFrame | None = None) -> None:
    """Rows as lines, after those of head, if any."""
    names = [x.split()[0] for x in GTF.split(", ")]
    lines = df.select(F.concat_ws("\t", *[F.col(n).cast("string") for n in names]).alias("value"))
    (head.coalesce(1).union(lines) if head is not None else lines).write.mode("overwrite").text(path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id, strand, start, end of exons: a line mRNA and the lines exon that follow it at once.

    Records are split at mRNA, so that each has its exons, wherever Spark cuts the file.
    """
    lines = F.split("value", "\n")
    raw = spark.read.option("lineSep", "\tmRNA\t").text(path).filter(F.col("value").rlike(r"^\d+\t\d+\t[^\t\n]*\t[-+.?]\t"))
    r = raw.select(F.regexp_extract(lines[0], r"ID=([^;\r]*)", 1).alias("transcript_id"), F.split(lines[0], "\t")[3].alias("strand"), F.slice(lines, F.lit(2), F.size(lines)).alias("l"))
    kind = F.transform("l", lambda x: F.coalesce(F.get(F.split(x, "\t"), F.lit(2)) == "exon", F.lit(False)))
    other = F.array_position(kind, F.lit(False))
    own = F.slice("l", F.lit(1), F.when(other > 0, other - 1).otherwise(F.size("l")).cast("int"))
    e = r.select("transcript_id", "strand", F.explode(own).alias("x")).withColumn("x", F.split("x", "\t"))
    return e.select("transcript_id", "strand", F.col("x")[3].cast("int").alias("start"), F.col("x")[4].cast("int").alias("end"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    schema = "chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="").select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")


def strain_variants(vcf: DataFrame, minimum_quality: float = 0.0, passed: bool = True) -> DataFrame:
    v = vcf.filter(F.coalesce(F.expr("try_cast(qual AS double)"), F.lit(0.0)) >= minimum_quality)
    return v.filter(F.col("filter").isin("PASS", ".")) if passed else v


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """transcript, chrom, positions of variant sites."""
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        c[0].alias("transcript"), c[1].alias("chrom"), F.transform(F.slice(c, F.lit(3), F.size(c)), lambda x: x.cast("int")).alias("positions")
    )


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(c[0].alias("transcript_hap"), c[1].alias("alleles"))
