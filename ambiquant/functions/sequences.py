"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambiquant.operators.intervals import spliced_positions

#: Letters of a chromosome that exons are cut from at once.
PIECE = 1 << 16


def tokens(c: Column, delimiters: str = " \t") -> Column:
    """Words between runs of delimiters."""
    return F.filter(F.split(c, "[" + delimiters + "]+"), lambda x: x != "")


def strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def reverse_complement(c: Column) -> Column:
    """Letters other than A, C, G and T are dropped."""
    return F.reverse(F.translate(F.regexp_replace(c, "[^ACGT]", ""), "ACGT", "TGCA"))


def flip_allele(c: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("not an allele: "), c)).cast("string")
    return F.when(c.rlike("^[ACGT]+$"), F.translate(c, "ACGT", "TGCA")).otherwise(bad)


def substitute(seq: Column, at: Column, alleles: Column) -> Column:
    """seq with a letter of `alleles` at each 0-based place of the array `at`."""
    pairs = F.arrays_zip(at.alias("p"), F.transform(F.sequence(F.lit(1), F.size(at)), lambda i: F.substring(alleles, i, 1)).alias("a"))
    return F.aggregate(pairs, seq, lambda s, z: F.overlay(s, z["a"], z["p"] + 1, F.lit(1)))


def splice(chromosomes: DataFrame, exons: DataFrame) -> DataFrame:
    """transcript_id, gene_id, seq of exons on chromosomes (chrom, seq); reversed on the minus strand.

    Starts and ends are sorted each by itself.  Features that reach beyond the sequence, or
    beyond the columns first and last if chromosomes have them, are left out.  Exons meet
    pieces of PIECE letters, not whole chromosomes; a feature's letters are put together last.
    """
    first = F.col("first") if "first" in chromosomes.columns else F.lit(1)
    last = F.least("last", F.length("seq")) if "last" in chromosomes.columns else F.length("seq")
    bounds = chromosomes.select("chrom", first.alias("_first"), last.alias("_last"))
    # as bytes, where a place is found without reading what is before it
    letters = F.col("seq").cast("binary")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("seq") - 1) / PIECE).cast("int"))), lambda i: F.substring(letters, i * PIECE + 1, F.lit(PIECE)))
    pieces = chromosomes.select("chrom", F.posexplode(cut).alias("_piece", "_text"))
    keys = ["transcript_id", "gene_id", "chrom", "strand"]
    t = exons.groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("starts"), F.array_sort(F.collect_list("end")).alias("ends"))
    t = t.join(bounds, "chrom").filter((F.element_at("starts", 1) >= F.col("_first")) & (F.element_at("ends", -1) <= F.col("_last")))
    e = t.select(*keys, F.posexplode(F.arrays_zip("starts", "ends")).alias("_exon", "_e")).select(*keys, "_exon", F.col("_e.starts").alias("_from"), F.col("_e.ends").alias("_to"))
    number = lambda c: F.floor((F.col(c) - 1) / PIECE).cast("int")
    e = e.withColumn("_piece", F.explode(F.sequence(number("_from"), F.greatest(number("_from"), number("_to")))))
    begin, end = F.greatest(F.col("_from") - F.col("_piece") * PIECE, F.lit(1)), F.least(F.col("_to") - F.col("_piece") * PIECE, F.lit(PIECE))
    part = F.substring("_text", begin, F.greatest(end - begin + 1, F.lit(0))).cast("string")
    j = e.join(pieces, ["chrom", "_piece"]).withColumn("_part", part)
    whole = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_exon", "_piece", "_part"))).alias("_p"))
    seq = F.array_join(F.transform("_p", lambda x: x["_part"]), "")
    return whole.select("transcript_id", "gene_id", F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq).alias("seq"))


def variant_sites(positions: DataFrame, exons: DataFrame) -> DataFrame:
    """transcript, at, kept: 0-based places in the spliced sequence, by the order of the positions.

    positions: transcript, positions (an array); exons: transcript_id, start, end.  kept has the
    numbers (1-based) of the positions that lie in an exon; others are left out of both.
    """
    p = positions.select(F.col("transcript").alias("transcript_id"), F.posexplode("positions").alias("_i", "pos"))
    s = spliced_positions(p, exons).groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("_i", "at"))).alias("_s"))
    return s.select(F.col("transcript_id").alias("transcript"), F.transform("_s", lambda x: x["at"].cast("int")).alias("at"), F.transform("_s", lambda x: x["_i"] + 1).alias("kept"))


def haplotypes(features: DataFrame, sites: DataFrame, alleles: DataFrame) -> DataFrame:
    """header, seq: two rows (_A and _B, of feature and gene) for features with sites, others unchanged.

    features: transcript, gene, seq, strand.  sites: transcript and at, an array of 0-based
    places in the spliced sequence on the forward strand, and, if not all alleles have one,
    kept, the numbers of those that do.  alleles: transcript_hap, alleles.  A feature whose
    haplotypes come out equal is one row with its plain name.
    """
    head = lambda suffix: F.concat("transcript", suffix, F.lit(" gene:"), "gene", suffix)
    plain = features.join(sites.select("transcript"), "transcript", "left_anti").select(head(F.lit("")).alias("header"), "seq")
    names = alleles.withColumn("transcript", F.regexp_replace("transcript_hap", "_[AB]$", ""))
    both = features.join(sites, "transcript").join(names, "transcript")
    if "kept" in sites.columns:
        both = both.withColumn("alleles", F.array_join(F.transform("kept", lambda i: F.substring("alleles", i, F.lit(1))), ""))
    minus = F.col("strand") == "-"
    at = F.when(minus, F.transform("at", lambda p: F.length("seq") - 1 - p)).otherwise(F.col("at"))
    letters = F.when(minus, flip_allele(F.col("alleles"))).otherwise(F.col("alleles"))
    d = both.withColumns({"_at": at, "_l": letters}).withColumn("_new", substitute(F.col("seq"), F.col("_at"), F.col("_l")))
    rows = F.array_sort(F.collect_list(F.struct("transcript_hap", F.col("_new").alias("new"))))
    d = d.groupBy("transcript", "gene").agg(rows.alias("_r")).withColumn("_same", F.size(F.array_distinct(F.transform("_r", lambda x: x["new"]))) == 1)
    d = d.select("transcript", "gene", "_same", F.explode(F.when(F.col("_same"), F.slice("_r", 1, 1)).otherwise(F.col("_r"))).alias("_x"))
    suffix = F.when(F.col("_same"), "").otherwise(F.regexp_extract("_x.transcript_hap", "_[AB]$", 0))
    return plain.union(d.select(head(suffix).alias("header"), F.col("_x.new").alias("seq")))


def rendered(members: Column, sign: str) -> Column:
    """Name of a set: members joined by + (identical) or * (collapsed, sorted)."""
    return F.array_join(F.array_sort(members) if sign == "*" else members, sign)


def members_of(name: Column) -> Column:
    return F.flatten(F.transform(F.split(name, "\\+"), lambda x: F.split(x, "\\*")))


def label_of(path: Column) -> Column:
    """File name without directories and its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
