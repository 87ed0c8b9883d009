"""Posterior summaries of traces, collation over samples, and calls."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambiquant.functions.statistics import digamma, inverse_normal, sokal_udf, trigamma
from ambiquant.operators.selection import nth, with_rank


def arrays(trace: DataFrame, *keys: str) -> DataFrame:
    """keys and values, the trace in the order of iterations."""
    g = trace.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("iter", "value"))).alias("t"))
    return g.select(*keys, F.transform("t", lambda x: x["value"]).alias("values"))


def nearest_rank(values: str, p: float) -> Column:
    """Quantile by rank floor(p / 100 * (n - 1) + 0.5), without interpolation."""
    return F.get(F.sort_array(values), F.floor(F.lit(p) / 100 * (F.size(values) - 1) + 0.5).cast("int"))


def summarise(trace: DataFrame, percentiles: tuple[float, ...] = (5, 25, 50, 75, 95), key: str = "feature") -> DataFrame:
    """log_mu (mean of the log trace), sd, mcse, iact and percentiles of each feature."""
    return summarise_arrays(arrays(trace.select(key, "iter", F.log("value").alias("value")), key), percentiles, key)


def summarise_arrays(logs: DataFrame, percentiles: tuple[float, ...] = (5, 25, 50, 75, 95), key: str = "feature", *more: str) -> DataFrame:
    """`summarise` of arrays (key, values) of log traces; columns `more` are kept."""
    a = logs.withColumn("s", sokal_udf("values"))
    n = F.size("values")
    mean = F.aggregate("values", F.lit(0.0), lambda x, v: x + v) / n
    failed = F.isnan(F.col("s.tau"))
    return a.select(
        key, mean.alias("log_mu"), F.sqrt("s.var").alias("sd"),
        F.when(failed, n.cast("double")).otherwise(F.sqrt(F.col("s.tau") * F.col("s.var") / n)).alias("mcse"),
        F.when(failed, F.lit(float("nan"))).otherwise(F.col("s.tau")).alias("iact"),
        F.array(*[nearest_rank("values", p) for p in percentiles]).alias("percentiles"), *more,
    )


def set_traces(trace: DataFrame, sets: DataFrame) -> DataFrame:
    """Traces of sets (set_id, feature): sums of the members' traces."""
    return trace.join(sets, "feature").groupBy("set_id", "iter").agg(F.sum("value").alias("value"))


def proportions(trace: DataFrame, genes: DataFrame) -> DataFrame:
    """feature, gene, iter, value: the share of the gene's total in each iteration."""
    t = trace.join(genes, "feature")
    return t.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("gene", "iter")))


def probit_moments(shares: DataFrame) -> DataFrame:
    """mean_proportion, mean and sd of probits; a feature alone in its gene has an infinite mean and no sd."""
    m = shares.withColumn("z", inverse_normal("value")).groupBy("gene", "feature").agg(F.avg("value").alias("mean_proportion"), F.avg("z").alias("m"), F.stddev_samp("z").alias("s"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("gene")) == 1
    return m.select("gene", "feature", "mean_proportion", F.when(alone, float("inf")).otherwise(F.col("m")).alias("mean_probit_proportion"), F.when(alone, float("nan")).otherwise(F.col("s")).alias("sd_probit_proportion"))


def with_unseen(meta: DataFrame, summary: DataFrame, scale: float, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """All features of meta; those without a summary get the prior's moments, mcse 0 and iact 1."""
    rate = F.lit(beta) + F.col("effective_length") * F.lit(scale)
    j = meta.join(summary, "feature", "left").withColumn("observed", F.col("log_mu").isNotNull().cast("int"))
    return j.withColumns(
        {
            "log_mu": F.coalesce("log_mu", F.lit(digamma(alpha)) - F.log(rate)),
            "sd": F.coalesce("sd", F.lit(math.sqrt(trigamma(alpha)))),
            "mcse": F.coalesce("mcse", F.lit(0.0)),
            "iact": F.coalesce("iact", F.lit(1.0)),
        }
    )


def with_prior(trace: DataFrame, prior: DataFrame) -> DataFrame:
    """The traces of observed features, and the prior's of those that have none: what sets and groups are sums of."""
    return trace.unionByName(prior.join(trace.select("feature").distinct(), "feature", "left_anti"))


def set_table(summary: DataFrame, sets: DataFrame, members: DataFrame, unique: DataFrame, scale: float, alpha: float = 0.1, beta: float = 0.1, identical: bool = False, trace_length: int = 1024) -> DataFrame:
    """The table of sets (genes, or sets of features with one sequence), seen or not.

    summary: set_id and the summary of its whole trace; sets: set_id, feature; members:
    feature, effective_length, true_length, observed, log_mu; unique: set_id, k.  observed is
    the number of members with reads.  A set without any: a group keeps the moments of its
    simulated trace, with mcse sd / sqrt(trace length) and iact 1; a set of one sequence has
    those of the prior, scaled by its size, without iact and percentiles.  A group's length is
    the mean of its members', weighted by abundance; it has no true length.
    """
    w = F.exp("log_mu")
    m = sets.join(members, "feature").groupBy("set_id").agg(
        F.sum("observed").cast("bigint").alias("observed"), F.count(F.lit(1)).alias("ntranscripts"),
        (F.sum(F.col("effective_length") * w) / F.sum(w)).alias("_weighted"), F.min_by("effective_length", "feature").alias("_first"), F.min_by("true_length", "feature").alias("_true"),
    )
    t = m.join(summary, "set_id", "left").join(unique.select("set_id", F.col("k").alias("unique_hits")), "set_id", "left")
    none = F.col("observed") == 0
    if identical:
        t = t.withColumns(
            {
                "log_mu": F.when(none, F.log("ntranscripts") + F.lit(digamma(alpha)) - F.log(F.lit(beta) + F.col("_first") * F.lit(scale))).otherwise(F.col("log_mu")),
                "sd": F.when(none, F.lit(math.sqrt(trigamma(alpha)))).otherwise(F.col("sd")),
                "mcse": F.when(none, F.lit(0.0)).otherwise(F.col("mcse")),
                "iact": F.when(~none, F.col("iact")),
                "percentiles": F.when(none, F.transform("percentiles", lambda x: F.lit(None).cast("double"))).otherwise(F.col("percentiles")),
            }
        )
    else:
        t = t.withColumns({"mcse": F.when(none, F.col("sd") / math.sqrt(trace_length)).otherwise(F.col("mcse")), "iact": F.when(none, F.lit(1.0)).otherwise(F.col("iact"))})
    length, whole = (F.col("_first"), F.col("_true")) if identical else (F.col("_weighted"), F.lit(None).cast("int"))
    order = ["observed", "ntranscripts"] if identical else ["ntranscripts", "observed"]
    return t.select(
        F.col("set_id").alias("feature_id"), "log_mu", "sd", "mcse", "iact", length.alias("effective_length"), whole.alias("true_length"),
        F.coalesce("unique_hits", F.lit(0)).cast("bigint").alias("unique_hits"), *order, "percentiles",
    )


def coverage_ranking(counts: DataFrame, features: DataFrame, rank: int = 500) -> DataFrame:
    """transcript, gene, coverage of the features that are covered best, one for each gene.

    counts: transcript, n (reads); features: transcript, gene, length, ordinal.  Coverage is
    reads a base; the bound is that of the feature at `rank` (0-based, in descending order; all
    pass if there are no more).  Of a gene's features that reach it the first by ordinal stands.
    """
    c = features.join(counts, "transcript", "left").withColumn("coverage", F.coalesce("n", F.lit(0)) / F.col("length"))
    # the largest rank + 1 values meet in one task, no others
    bound = c.orderBy(F.col("coverage").desc()).limit(rank + 1).agg(F.min("coverage").alias("_least"), F.count(F.lit(1)).alias("_n"))
    bound = bound.select(F.when(F.col("_n") > rank, F.col("_least")).otherwise(F.lit(0.0)).alias("_bound"))
    good = c.crossJoin(F.broadcast(bound)).filter("coverage >= _bound")
    return good.groupBy("gene").agg(F.min_by(F.struct("transcript", "coverage"), "ordinal").alias("x")).select("x.transcript", "gene", "x.coverage")


def common_set(table: DataFrame, names: DataFrame, suffix: str = "") -> DataFrame:
    """Rows of `table` for names (feature, ordinal), in their order: a name that the table lacks has nulls beside it.

    suffix (a pattern) is cut from the table's features first.
    """
    t = table.withColumn("feature", F.regexp_replace("feature", suffix, "")) if suffix else table
    return names.join(t, "feature", "left").select("ordinal", *table.columns).orderBy("ordinal")


def bound_factors(comparisons: list[DataFrame]) -> DataFrame:
    """feature and bf, an array of the Bayes factors of several comparisons (feature, bayes_factor), bound by feature."""
    named = [c.select("feature", F.col("bayes_factor").alias(f"_b{i}")) for i, c in enumerate(comparisons)]
    j = reduce(lambda a, b: a.join(b, "feature"), named)
    return j.select("feature", F.array(*[F.col(f"_b{i}") for i in range(len(named))]).alias("bf"))


def weighted_length(quant: DataFrame) -> DataFrame:
    """gene, effective_length: the mean of its features' lengths, weighted by abundance."""
    w = F.exp("log_mu")
    return quant.groupBy("gene").agg((F.sum(F.col("effective_length") * w) / F.sum(w)).alias("effective_length"))


def collate(samples: dict[str, DataFrame]) -> DataFrame:
    """feature, sample, y, e, uh of several samples' tables (log_mu, sd, unique_hits)."""
    parts = [d.select("feature", F.lit(s).alias("sample"), F.col("log_mu").alias("y"), F.col("sd").alias("e"), F.col("unique_hits").alias("uh")) for s, d in samples.items()]
    return reduce(DataFrame.unionByName, parts)


def incomplete(long: DataFrame, n_samples: int) -> DataFrame:
    """Features that not every sample has exactly once; there must be none."""
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample").alias("s")).filter((F.col("n") != n_samples) | (F.col("s") != n_samples))


def default_share(n: int) -> float:
    """Share of samples in which a feature must have unique hits to be used for normalisation."""
    return max(0.2, (n - n * n // 160) / n)


def _usable(long: DataFrame, share: float) -> DataFrame:
    return long.groupBy("feature").agg(F.avg((F.col("uh") > 0).cast("int")).alias("f")).filter(F.col("f") >= share).select("feature")


def normalise_upper_median(long: DataFrame, share: float, least: int = 100) -> DataFrame:
    """y less the sample's upper median of (y - mean over samples), over usable features; unchanged if too few."""
    d = long.join(_usable(long, share), "feature").withColumn("d", F.col("y") - F.avg("y").over(Window.partitionBy("feature")))
    med = nth(d, ["sample"], "d", lambda n: F.floor(n / 2)).select("sample", F.when(F.col("n") >= least, F.col("nth")).otherwise(0.0).alias("shift"))  # one row a sample
    return long.join(F.broadcast(med), "sample").withColumn("y", F.col("y") - F.col("shift")).drop("shift")


def normalise_median(long: DataFrame, share: float) -> DataFrame:
    """y less the sample's median (middle two averaged) of finite deviations."""
    ok = long.join(_usable(long, share), "feature").filter(~F.isnan("y") & (F.abs("y") != float("inf")))
    d = ok.withColumn("d", F.col("y") - F.avg("y").over(Window.partitionBy("feature")))
    low, high = (nth(d, ["sample"], "d", lambda n, k=k: F.floor((n - k) / 2)).select("sample", F.col("nth").alias(f"_{k}")) for k in (1, 0))
    med = low.join(high, "sample").select("sample", (F.col("_1") + (F.col("_0") - F.col("_1")) * 0.5).alias("shift"))
    return long.join(F.broadcast(med), "sample", "left").withColumn("y", F.col("y") - F.coalesce("shift", F.lit(0.0))).drop("shift")


def estimated_counts(quant: DataFrame, n_mapped: Column | int) -> DataFrame:
    n = n_mapped if isinstance(n_mapped, Column) else F.lit(n_mapped)
    return quant.withColumn("count", F.coalesce(F.exp("log_mu") * n * F.col("effective_length") / 1e9, F.lit(0.0)))


def polyclass(factors: DataFrame, prior: list[float]) -> DataFrame:
    """feature and probabilities of models 0.. from the array bf of Bayes factors against model 0."""
    weights = F.array(*[F.lit(float(p)) for p in prior])
    bf = F.concat(F.array(F.lit(1.0)), F.col("bf"))
    infinite = F.exists("bf", lambda x: x == float("inf"))
    w = F.when(infinite, F.transform(bf, lambda x: F.when(x == float("inf"), 1.0).otherwise(0.0))).otherwise(F.zip_with(bf, weights, lambda x, p: x * p))
    d = factors.select("feature", w.alias("w")).withColumn("t", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    return d.select("feature", F.transform("w", lambda x: x / F.col("t")).alias("probabilities"))


def expressed(quant: DataFrame, least_hits: int = 1) -> DataFrame:
    """feature, gene, expressed: above the least log_mu of the features with enough unique hits."""
    low = quant.filter(F.col("unique_hits") >= least_hits).agg(F.min("log_mu").alias("_low"))
    return quant.crossJoin(F.broadcast(low)).select("feature", "gene", F.coalesce(F.col("log_mu") > F.col("_low"), F.lit(False)).alias("expressed"))


def expressed_genes(calls: DataFrame) -> DataFrame:
    return calls.groupBy("gene").agg(F.bool_or("expressed").alias("expressed"))


def feature_range(long: DataFrame, start: int, end: int, n: int) -> DataFrame:
    """Features start..end (0-based, both within) in name order; all if the range is no proper one."""
    if not 0 <= start < end < n:
        return long
    names = with_rank(long.select("feature").distinct(), "feature", name="_i")
    return long.join(names.filter(F.col("_i").between(start, end)).select("feature"), "feature", "left_semi")


def several_isoforms(long: DataFrame, first_sample: str) -> DataFrame:
    """Without features whose y is infinite in the first sample."""
    bad = long.filter((F.col("sample") == first_sample) & (F.abs("y") == float("inf"))).select("feature")
    return long.join(bad, "feature", "left_anti")


def split_by_suffix(long: DataFrame, suffixes: list[str]) -> DataFrame:
    """Pseudo-samples: features with a suffix (a pattern) lose it and go to sample.suffix."""
    parts = [
        long.filter(F.col("feature").rlike(f"{s}$")).withColumns({"feature": F.regexp_replace("feature", f"{s}$", ""), "sample": F.concat_ws(".", "sample", F.lit(s))})
        for s in suffixes
    ]
    return reduce(DataFrame.unionByName, parts)


def permuted(long: DataFrame, seed: int) -> DataFrame:
    """(y, e) dealt to the samples of each feature in a random order that follows from the seed."""
    order = Window.partitionBy("feature").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "feature", "sample")), "sample")
    names = Window.partitionBy("feature").orderBy("sample")
    a = long.select("feature", "sample", "uh", F.row_number().over(names).alias("_i"))
    b = long.select("feature", "y", "e", F.row_number().over(order).alias("_i"))
    return a.join(b, ["feature", "_i"]).drop("_i")
