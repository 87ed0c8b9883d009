"""Filters from alignments to reads with candidate features.

Every step is a window over one read (or one read and feature), so all of them share a
single shuffle by read.  Alignments: read, transcript, isize, nm, ordinal (order in the
input, for ties).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Flag bits of a read that is unmapped, or whose mate is.
UNMAPPED = 0xC


def mapped_pairs(df: DataFrame, flag: str = "flag") -> DataFrame:
    return df.filter(F.col(flag).bitwiseAND(F.lit(UNMAPPED)) == 0)


def best_stratum(df: DataFrame) -> DataFrame:
    """Alignments with the fewest mismatches of their read."""
    low = F.min("nm").over(Window.partitionBy("read"))
    return df.withColumn("_low", low).filter(F.col("nm") == F.col("_low")).drop("_low")


def one_per_feature(df: DataFrame, expected: int) -> DataFrame:
    """Of a read's alignments to a feature, the one of the most expected insert size; the first on ties."""
    order = Window.partitionBy("read", "transcript").orderBy(F.abs(F.col("isize") - expected), "ordinal")
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def near_expected(df: DataFrame, expected: int, threshold: int) -> DataFrame:
    """Alignments within `threshold` of the expected insert size; all of a read that has none.

    A threshold below 20 turns the filter off.
    """
    if threshold < 20:
        return df
    off = F.abs(F.col("isize") - expected)
    low = F.min(off).over(Window.partitionBy("read"))
    return df.withColumn("_low", low).filter((F.col("_low") > threshold) | (off <= threshold)).drop("_low")


def pipeline(df: DataFrame, expected: int = 180, threshold: int = 49, merge_haplotypes: bool = False, paired: bool = True) -> DataFrame:
    """read, transcripts (sorted, distinct) after the filters in their order."""
    d = best_stratum(df)
    if paired:
        d = near_expected(one_per_feature(d, expected), expected, threshold)
    if merge_haplotypes:
        d = d.withColumn("transcript", F.regexp_replace("transcript", "_[AB]$", ""))
    return read_sets(d)


def stage_counts(df: DataFrame, expected: int = 180, threshold: int = 49) -> DataFrame:
    """stage, n: alignments left after each filter, in one job."""
    low = Window.partitionBy("read")
    a = df.withColumn("s1", F.col("nm") == F.min("nm").over(low))
    order = Window.partitionBy("read", "transcript", "s1").orderBy(F.abs(F.col("isize") - expected), "ordinal")
    b = a.withColumn("s2", F.col("s1") & (F.row_number().over(order) == 1))
    off = F.abs(F.col("isize") - expected)
    least = F.min(F.when(F.col("s2"), off)).over(low)
    c = b.withColumn("s3", F.col("s2") & ((least > threshold) | (off <= threshold)))
    total = c.agg(F.count(F.lit(1)).alias("input"), *[F.count_if(s).alias(n) for s, n in (("s1", "stratum"), ("s2", "feature"), ("s3", "deviation"))])
    return total.unpivot([], ["input", "stratum", "feature", "deviation"], "stage", "n")


def pair_mates(df: DataFrame, documented: bool = True) -> DataFrame:
    """One row for both mates: same read and feature, each at the other's mate position.

    Alignments at one place with one mate position are numbered by ordinal, and the n-th meets the n-th
    of the mirrored ones; where both positions are one, neighbours meet.  So equal first
    mates stay rows of their own, and one without a partner is a row by itself.

    nm is the sum of both; with documented=False it is the second mate's, as some tools have it.
    """
    place = ["read", "transcript", F.least("pos", "mpos").alias("left"), F.greatest("pos", "mpos").alias("right")]
    side = Window.partitionBy("read", "transcript", "pos", "mpos").orderBy("ordinal")
    own = F.row_number().over(side) - 1
    numbered = df.withColumn("_n", F.when(F.col("pos") == F.col("mpos"), F.floor(own / 2)).otherwise(own))
    nm = F.sum("nm") if documented else F.max_by("nm", "ordinal")
    met = numbered.groupBy(*place, "_n").agg(nm.alias("nm"), F.max("isize").alias("isize"), F.count(F.lit(1)).alias("n_mates"), F.min("ordinal").alias("ordinal"))
    return met.drop("_n")


def read_sets(df: DataFrame) -> DataFrame:
    return df.groupBy("read").agg(F.array_sort(F.collect_set("transcript")).alias("transcripts"))


def read_probe(df: DataFrame) -> DataFrame:
    """Longest read, and whether any is of a pair, in one aggregation of the input."""
    return df.agg(F.max("read_length").alias("read_length"), F.bool_or(F.col("flag").bitwiseAND(F.lit(1)) != 0).alias("paired"))


def insert_sizes(df: DataFrame, most: int | None = 2_000_000) -> DataFrame:
    """read, isize of reads whose positive template lengths agree; the first `most` by ordinal."""
    each = df.filter("tlen > 0").groupBy("read").agg(F.min("tlen").alias("isize"), F.max("tlen").alias("_max"), F.min("ordinal").alias("ordinal"))
    each = each.filter("isize = _max").select("read", "isize", "ordinal")
    return each.orderBy("ordinal").limit(most) if most else each


def insert_size_model(sizes: DataFrame) -> DataFrame:
    """mode, threshold, sd of insert sizes, by counts of each size.

    The top 2.5% are cut, counts are summed over three neighbouring sizes, and the
    earliest size with the largest sum is the mode.
    """
    counts = sizes.groupBy("isize").agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("isize")  # rows are distinct sizes, at most a few thousand
    c = counts.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    hi = c.filter(F.col("upto") > F.floor(F.col("total") * 0.975)).agg(F.min("isize").alias("hi"), F.lit(1).alias("k"))
    lo = c.agg(F.min("isize").alias("lo"))
    grid = hi.crossJoin(lo).select("hi", "lo", F.explode(F.sequence("lo", "hi")).alias("isize"))
    full = grid.join(counts, "isize", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    three = F.sum("n").over(Window.orderBy("isize").rowsBetween(-1, 1))
    inner = full.withColumn("s", three).filter((F.col("isize") > F.col("lo")) & (F.col("isize") <= F.col("hi") - 2))
    best = inner.agg(F.min_by("isize", F.struct(-F.col("s"), F.col("isize"))).alias("mode"), F.max("hi").alias("hi"))
    return best.select("mode", (F.col("hi") - F.col("mode")).alias("threshold"), F.floor((F.col("hi") - F.col("mode")) / 1.96).cast("int").alias("sd"))


def histogram(sizes: DataFrame, width: int = 10, bar: int = 60) -> DataFrame:
    """bin, n and a bar of at most `bar` signs."""
    h = sizes.groupBy((F.floor(F.col("isize") / width) * width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy())
    return h.withColumn("_top", top).select("bin", "n", F.expr(f"rpad('', cast(floor(n * {bar} / _top) as int), '*')").alias("bar"))
