"""Command line: python -m ambiquant.cli COMMAND --help."""

from __future__ import annotations

import argparse
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ambiquant.functions import sequences as sq
from ambiquant.functions.statistics import effective_lengths, fit_position_weights, positional_lengths
from ambiquant.operators import alignments as al
from ambiquant.operators import classes as cl
from ambiquant.operators import intervals as iv
from ambiquant.operators import summaries as sm
from ambiquant.plans import abundance, comparison
from ambiquant.plans import collapse as cp
from ambiquant.session import build, cut, ship
from ambiquant.sources import bam, hits, tables
from ambiquant.sources import sequences as src

SCALE = 1e-9


def make_hits(spark: SparkSession, a: argparse.Namespace) -> None:
    """Alignments (SAM text, or BAM if the name ends so) and sequences to a hits file."""
    fasta = src.features_of(src.header_ids(src.read_fasta(spark, a.fasta), a.pattern, a.feature_group, a.gene_group), a.merge_haplotypes)
    binary = bam.read_bam(spark, a.sam) if a.sam.endswith(".bam") else None
    sam = binary["alignments"] if binary else src.read_sam(spark, a.sam)
    if a.paired is None:
        a.paired = bool(al.read_probe(sam).first()["paired"])
    sam = al.mapped_pairs(sam) if a.paired else sam.filter(F.col("flag").bitwiseAND(F.lit(4)) == 0)
    known = sam.withColumnsRenamed({"qname": "read", "rname": "transcript"})
    if a.merge_haplotypes:  # before mates meet, which may name different haplotypes
        known = known.withColumn("transcript", src.strip_haplotype("transcript"))
    order = src.order_of(binary["headers"].select(F.explode(F.split("text", "\n")).alias("value"))) if binary else src.sort_order(spark, a.sam)
    if order not in (None, "queryname", "unknown", "unsorted"):
        print(f"note: {a.sam} is sorted by {order}; mates are matched all the same")
    several = [r[0] for r in cl.multiple_genes(fasta).limit(3).collect()]
    if several:
        raise SystemExit(f"features of several genes: {several}")
    named = binary["references"] if binary else src.sam_references(spark, a.sam)
    if a.merge_haplotypes:
        named = named.withColumn("rname", src.strip_haplotype("rname"))
    unknown = src.unknown_references(known.select(F.col("transcript").alias("rname")).union(named).distinct(), fasta).limit(3).collect()
    if unknown:
        raise SystemExit(f"references without a sequence: {[r[0] for r in unknown]}")
    mean, sd, threshold = a.insert_size or (180, 25, 49)
    if a.paired and not a.insert_size:
        m = al.insert_size_model(al.insert_sizes(known)).first()
        if m and m["mode"] is not None:
            mean, sd, threshold = m["mode"], max(1, m["sd"]), m["threshold"]
    paired = al.pair_mates(known) if a.paired else known
    reads = al.pipeline(paired, mean, threshold, a.merge_haplotypes, a.paired)
    meta = effective_lengths(fasta.select("transcript", "true_length", "effective_length"), mean, sd).select("transcript", "effective_length", "true_length")
    if a.fit_positions:
        probe = al.read_probe(sam).first()
        weights, intercept, steps = fit_positions(spark, known, fasta)
        print(f"position weights: {steps} steps, intercept {intercept:.6f}")
        adjusted = positional_lengths(fasta.select("transcript", "seq"), weights, intercept, probe["read_length"] or 0, a.paired)
        meta = meta.drop("effective_length").join(adjusted.select("transcript", "effective_length"), "transcript").select("transcript", "effective_length", "true_length")
    if a.lengths:
        meta = tables.adjusted_lengths(meta, spark.read.csv(a.lengths, sep="\t", schema="transcript string, length double"))
    hits.write_text(reads, meta, cl.gene_isoforms(fasta), cl.identical_sets(fasta).withColumnRenamed("members", "transcripts"), a.out)


def fit_positions(spark: SparkSession, known: DataFrame, fasta: DataFrame, most: int = 500) -> tuple[dict[str, list[float]], float, int]:
    """Position weights from the features that are covered best, one of each gene."""
    total = known.groupBy("transcript").agg(F.count(F.lit(1)).alias("n"))
    best = sm.coverage_ranking(total, fasta.select("transcript", "gene", F.col("true_length").alias("length"), F.col("transcript").alias("ordinal")), most)
    own = cut(fasta.join(best.select("transcript"), "transcript", "left_semi").select("transcript", "seq"))
    at = known.groupBy("transcript", (F.col("pos") - 1).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    places = own.select("transcript", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("i")).join(at, ["transcript", "i"], "left")
    counts = places.groupBy("transcript").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
    return fit_position_weights(own.join(counts, "transcript").select("seq", F.col("c.n").alias("counts")))


def quantify(spark: SparkSession, a: argparse.Namespace) -> None:
    """A hits file to tables of features, identical sets and genes, and the traces."""
    h = hits.read(spark, a.hits)
    reads = cut(h["reads"])
    n, classes = reads.count(), cut(cl.equivalence_classes(reads))
    exposure = h["meta"].select("transcript", (F.col("effective_length") * (n * SCALE)).alias("l"))
    mu, _ = abundance.em(classes, exposure, a.epsilon, a.max_em_iter)
    trace = cut(abundance.gibbs(classes, exposure, a.gibbs_iter, 1024, a.alpha, a.beta, None, a.seed))
    p = tuple(float(x) for x in a.percentiles.split(","))
    em = mu.select(F.col("transcript").alias("feature"), F.log("mu").alias("log_mu_em"))
    unique = cl.unique_hits(classes).withColumnRenamed("transcript", "feature")
    meta = h["meta"].withColumnRenamed("transcript", "feature")
    genes = h["genes"].select(F.explode("transcripts").alias("feature"), "gene")
    # sums and shares are over all members: those without reads have traces drawn from the prior
    every = cut(sm.with_prior(trace, abundance.prior_traces(exposure, 1024, a.alpha, a.beta, a.seed)))
    seen = trace.select("feature").distinct()
    parts = cut(sm.proportions(every, genes))
    rank = F.array(*[sm.nearest_rank("values", x) for x in p])
    shares = sm.probit_moments(parts).join(sm.arrays(parts, "feature").select("feature", rank.alias("percentiles_proportion")), "feature").drop("gene")
    full = sm.with_unseen(meta, sm.summarise(trace, p), n * SCALE, a.alpha, a.beta)
    prior = sm.summarise(every.join(seen, "feature", "left_anti"), p).select("feature", F.col("percentiles").alias("_prior"))
    full = full.join(prior, "feature", "left").withColumn("percentiles", F.coalesce("percentiles", "_prior")).drop("_prior").join(unique, "feature", "left").join(em, "feature", "left").join(shares, "feature", "left").withColumn("unique_hits", F.coalesce("unique_hits", F.lit(0)))
    sizes = genes.select("feature", F.count(F.lit(1)).over(Window.partitionBy("gene")).cast("int").alias("ntranscripts"))
    full = cut(full.join(sizes, "feature", "left"))
    mapped = f" Mapped fragments: {n}"
    out = Path(a.out)
    tables.write_table(full.withColumnRenamed("feature", "feature_id").orderBy("feature_id"), str(out / "features"), mapped)
    for name, sets in (("genes", genes.select(F.col("gene").alias("set_id"), "feature")), ("identical", h["identical"].select(F.array_join("transcripts", "+").alias("set_id"), F.explode("transcripts").alias("feature")))):
        summary = sm.summarise(sm.set_traces(every, sets), p, "set_id")
        k = cl.contained_counts(classes, sets.withColumnRenamed("feature", "transcript"))
        tables.write_table(sm.set_table(summary, sets, full, k, n * SCALE, a.alpha, a.beta, name == "identical").orderBy("feature_id"), str(out / name), mapped)
    tables.write_traces(trace, str(out / "trace"))
    tables.write_table(abundance.convergence(trace).orderBy("feature"), str(out / "convergence"))
    if a.debug:
        debug(classes, reads, mu, out / "debug")


def debug(classes: DataFrame, reads: DataFrame, mu: DataFrame, out: Path) -> None:
    """What a run counted on the way, as tables: classes, sharing, rows of the incidence that repeat, the EM estimate."""
    sinks = {
        "classes": classes.select("class_id", F.array_join("members", ",").alias("members"), "k"), "incidence": cl.incidence(classes).select("class_id", "transcript"),
        "sharedcounts": cl.shared_counts(classes), "duplicates": cl.duplicate_rows(classes), "em": mu.select("transcript", "mu"),
        "doublehits": reads.groupBy(F.size("transcripts").alias("features")).agg(F.count(F.lit(1)).alias("reads")),
    }
    for name, df in sinks.items():
        tables.write_table(df, str(out / name))


def collapse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs of `quantify` to tables in which features that cannot be told apart are merged."""
    runs = {f"{i}:{Path(r).name}": Path(r) for i, r in enumerate(a.runs)}
    samples, traces, classes = {}, [], []
    for (name, run), file in zip(runs.items(), a.hits):
        h = hits.read(spark, file)
        q = tables.read_quant(spark, str(run / "features")).withColumnRenamed("feature_id", "feature")
        same = tables.read_quant(spark, str(run / "identical")).withColumnRenamed("feature_id", "feature")
        members = same.select("feature", F.explode(F.split("feature", "\\+")).alias("member"))
        part = lambda d, is_set: d.select("feature", "log_mu", "sd", "mcse", "iact", "effective_length", "unique_hits", F.lit(is_set).alias("is_set"), (F.col("observed") > 0).alias("observed"))
        inside = members.select(F.col("member").alias("feature"), F.lit(True).alias("_in")).distinct()
        both = part(q, False).unionByName(part(same, True)).join(inside, "feature", "left").withColumn("in_set", F.coalesce("_in", F.lit(False))).drop("_in")
        samples[name] = cut(both)
        t = spark.read.parquet(str(run / "trace"))
        sets = sm.set_traces(t, members.select(F.col("feature").alias("set_id"), F.col("member").alias("feature"))).withColumnRenamed("set_id", "feature")
        traces.append(t.select("feature", "iter", "value").unionByName(sets.select("feature", "iter", "value")).withColumn("sample", F.lit(name)))
        classes.append(cut(cl.equivalence_classes(h["reads"])))
    candidates = cut(cp.candidates(samples))
    # a set lies in the component of its members
    label = cl.components(reduce(DataFrame.unionByName, classes).select("class_id", "members", "k"), cut)
    groups = cut(candidates.select("feature", F.split("feature", "\\+")[0].alias("transcript")).join(label, "transcript").select("feature", "component"))
    trace = cut(reduce(DataFrame.unionByName, traces))
    known = cut(trace.join(groups.select("feature"), "feature"))
    # a set shares the reads of its members
    singles = candidates.select("feature", F.explode(F.split("feature", "\\+")).alias("transcript"))
    own = reduce(DataFrame.unionByName, [cl.incidence(c).select("class_id", "transcript") for c in classes]).join(singles, "transcript")
    pairs = cut(cp.covariances(known, cp.sharing(own.select("class_id", "feature")), groups))
    bound = a.bound
    if bound is None:
        found = cp.threshold(cp.mean_correlations(pairs), a.percent).first()
        bound = -1.0 if found is None or found[0] is None else min(0.0, found[0])
    variances = known.groupBy("sample", "feature").agg(F.var_samp("value").alias("var"))
    merged = cut(cp.collapse(pairs.select("sample", "a", "b", "cov"), variances, groups, bound).filter(F.size("members") > 1).select("members"))
    names = merged.select(F.array_join("members", "*").alias("set_id"), F.explode("members").alias("feature"))
    gone = names.select("feature")
    # the features that a merged set of identical ones stands for go with it, and it may stand for no others
    gone = gone.union(gone.select(F.explode(F.split("feature", "\\+")).alias("feature"))).distinct()
    out = Path(a.out)
    for (name, table), own in zip(samples.items(), classes):
        t = cp.collapsed_traces(trace.filter(F.col("sample") == name), merged)
        single = names.select("set_id", F.explode(F.split("feature", "\\+")).alias("transcript")).distinct()
        unique = cl.contained_counts(own, single).select(F.col("set_id").alias("feature"), F.col("k").alias("unique_hits"))
        stay = table.join(gone, "feature", "left_anti").filter(~F.col("in_set"))
        tables.write_table(cp.collapsed_table(sm.summarise(t), unique, stay), str(out / name.replace(":", "_")))
    tables.write_table(merged.select(F.array_join("members", "*").alias("set"), F.size("members").alias("n")).orderBy("set"), str(out / "sets"))


def polyclass(spark: SparkSession, a: argparse.Namespace) -> None:
    """Several comparisons with one model 0 to posterior probabilities of all models."""
    prior = a.model_prior or [1 / (len(a.tables) + 1)] * (len(a.tables) + 1)
    if len(prior) != len(a.tables) + 1 or abs(sum(prior) - 1) > 1e-8:
        raise SystemExit("give a prior for each model; they must add up to 1")
    found = sm.polyclass(sm.bound_factors([tables.read_quant(spark, t).withColumnRenamed("feature_id", "feature").withColumn("bayes_factor", F.col("bayes_factor").cast("double")) for t in a.tables]), prior)
    columns = [F.get("probabilities", F.lit(i)).alias(f"postprob_model{i}") for i in range(len(prior))]
    tables.write_table(found.select("feature", *columns).orderBy("feature"), a.out)


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tables of several samples to Bayes factors."""
    def read(f: str) -> DataFrame:
        d = tables.read_quant(spark, f)
        return d.withColumns({"log_mu": F.col("mean_probit_proportion"), "sd": F.col("sd_probit_proportion")}) if a.useprops else d

    key = lambda d: d.withColumnRenamed("feature_id", "feature") if "feature_id" in d.columns else d
    names = [f"{i}:{Path(f).stem}" for i, f in enumerate(a.tables)]
    long: DataFrame = sm.collate({n: key(read(f)) for n, f in zip(names, a.tables)})
    if sm.incomplete(long, len(names)).limit(1).count():
        raise SystemExit("samples differ in their features")
    if long.filter(F.col("y").isNull()).limit(1).count():
        raise SystemExit("a table has NA")
    if a.range:
        long = sm.feature_range(long, *a.range, long.select("feature").distinct().count())
    if a.useprops:  # features alone in their gene have no share to compare
        long = sm.several_isoforms(long, names[0])
    share = a.share or sm.default_share(len(names))
    if not 1 / len(names) <= share <= 1:
        raise SystemExit("the share must be between 1 / samples and 1")
    if a.burnin % 1024 or a.iterations % 1024:
        raise SystemExit("burn-in and iterations must be multiples of 1024")
    long = long if a.no_normalisation or a.useprops else sm.normalise_upper_median(long, share)
    long = sm.permuted(long, a.seed) if a.permute else long
    if a.matrices:
        m, c, p0, p1 = tables.parse_matrices(Path(a.matrices).read_text())
        design = comparison.from_matrices(m, c, p0, p1)
    else:
        design = comparison.two_groups(*a.groups)
    got = comparison.compare(long, names, design, a.prior, a.pdash, a.d, a.s, a.burnin, a.iterations, 0 if a.no_tuning else comparison.MOST_BATCHES, a.fix_alpha, a.seed)
    tables.write_table(comparison_table(got, design, names, a.fix_alpha).orderBy("feature_id"), a.out, f"prior_probability={a.prior}")


def comparison_table(got: DataFrame, design: comparison.Design, names: list[str], fix_alpha: bool) -> DataFrame:
    """One column for each coefficient, and mu_ and sd_ of each sample: its name, with its number if several have it."""
    plain = [n.split(":", 1)[1] for n in names]
    label = plain if len(set(plain)) == len(plain) else names
    each = lambda c, n, to: [F.get(c, F.lit(i)).alias(t) for i, t in zip(range(n), to)]
    columns = ["feature", "bayes_factor", "posterior_probability"]
    shown = [F.col("feature").alias("feature_id"), *columns[1:]]
    for m in (0, 1):
        shown += [] if fix_alpha else [f"alpha{m}"]
        for c, n in ((f"beta{m}", design.m.shape[1] if np.any(design.m) else 0), (f"eta{m}", design.p[m].shape[1] if np.any(design.p[m]) else 0)):
            shown += each(c, n, [f"{c}_{i}" for i in range(n)])
    return got.select(*shown, *each("y", len(names), [f"mu_{x}" for x in label]), *each("e", len(names), [f"sd_{x}" for x in label]), "tuned")


def inspect(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = hits.read(spark, a.hits)
    for k, (first, n) in hits.inspect(parts if not a.header else {x: d for x, d in parts.items() if x != "reads"}).items():
        print(k, n, *first, sep="\n  ")


def regroup(spark: SparkSession, a: argparse.Namespace) -> None:
    h = hits.read(spark, a.hits)
    genes = h["genes"].select(F.explode("transcripts").alias("transcript"), "gene")
    hits.to_binary(cl.regroup(h["reads"], genes)).write.mode("overwrite").parquet(a.out)


def offset(spark: SparkSession, a: argparse.Namespace) -> None:
    g = src.read_gtf(spark, a.gtf)
    src.write_gtf(iv.offset_exons(g, src.read_vcf(spark, a.vcf)), a.out, src.comments(spark, a.gtf))


def hits_to_text(spark: SparkSession, a: argparse.Namespace) -> None:
    """A hits file, of either form, to text."""
    h = hits.read(spark, a.hits)
    hits.write_text(h["reads"], h["meta"], h["genes"], h["identical"], a.out)


def hits_to_binary(spark: SparkSession, a: argparse.Namespace) -> None:
    """A hits file, of either form, to the parts of a binary file (cat joins them)."""
    hits.write_binary(hits.read(spark, a.hits), a.out)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """The spliced sequences of a GTF file's transcripts."""
    t = sq.splice(src.chromosomes_of(src.read_fasta(spark, a.fasta)), src.read_gtf(spark, a.gtf))
    src.write_fasta(t.select(F.concat("transcript_id", F.lit(" gene:"), "gene_id").alias("header"), "seq"), a.out)


def haplotypes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sequences of both haplotypes from phased alleles."""
    fasta = src.header_ids(src.read_fasta(spark, a.fasta), a.pattern)
    exons = src.read_gff(spark, a.gff)
    strands = exons.groupBy(F.col("transcript_id").alias("transcript")).agg(F.first("strand").alias("strand"))
    sites = sq.variant_sites(src.read_positions(spark, a.positions), exons)
    src.write_fasta(sq.haplotypes(fasta.join(strands, "transcript", "left"), sites, src.read_haplotypes(spark, a.alleles)), a.out)


def filter_gtf(spark: SparkSession, a: argparse.Namespace) -> None:
    """The rows of a GTF file whose transcripts a FASTA file has."""
    names = src.read_fasta(spark, a.fasta).select(F.regexp_extract("header", r"^(\S+)", 1).alias("transcript_id"))
    src.write_gtf(iv.only_known(src.read_gtf(spark, a.gtf, None), names, "transcript_id"), a.out)


def filter_fasta(spark: SparkSession, a: argparse.Namespace) -> None:
    """The entries of a FASTA file whose headers match a pattern, or do not."""
    src.write_fasta(src.grep_entries(src.read_fasta(spark, a.fasta), a.pattern, a.invert), a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *required: str) -> argparse.ArgumentParser:
        c = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        c.set_defaults(run=f)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        return c

    c = command(make_hits, "sam", "fasta", "out")
    c.add_argument("--pattern", default=src.HEADER)
    c.add_argument("--feature-group", type=int, default=1)
    c.add_argument("--gene-group", type=int, default=2)
    c.add_argument("--insert-size", type=int, nargs=3, metavar=("MEAN", "SD", "THRESHOLD"))
    c.add_argument("--lengths")
    c.add_argument("--merge-haplotypes", action="store_true")
    c.add_argument("--fit-positions", action="store_true", help="lengths by position-dependent read starts, fitted to the alignments")
    c.add_argument("--paired", action=argparse.BooleanOptionalAction, help="as the flags of the alignments say, unless given")
    c = command(quantify, "hits", "out")
    for name, value in (("alpha", 0.1), ("beta", 0.1), ("epsilon", 0.1)):
        c.add_argument(f"--{name}", type=float, default=value)
    for name, value in (("max-em-iter", 1000), ("gibbs-iter", 16384), ("seed", 1)):
        c.add_argument(f"--{name}", type=int, default=value)
    c.add_argument("--percentiles", default="5,25,50,75,95")
    c.add_argument("--debug", action="store_true")
    c = command(collapse, "out")
    c.add_argument("runs", nargs="+")
    c.add_argument("--hits", nargs="+", required=True)
    c.add_argument("--bound", type=float)
    c.add_argument("--percent", type=float, default=5.0)
    c = command(polyclass, "out")
    c.add_argument("tables", nargs="+")
    c.add_argument("--model-prior", type=float, nargs="+")
    c = command(compare, "out")
    c.add_argument("tables", nargs="+")
    c.add_argument("--groups", type=int, nargs="+")
    c.add_argument("--matrices")
    for name, value in (("prior", 0.1), ("pdash", 0.5), ("d", 1.4), ("s", 2.0), ("share", 0.0)):
        c.add_argument(f"--{name}", type=float, default=value)
    for name, value in (("burnin", 8192), ("iterations", 16384), ("seed", 1)):
        c.add_argument(f"--{name}", type=int, default=value)
    c.add_argument("--range", type=int, nargs=2, metavar=("START", "END"))
    for name in ("no-normalisation", "permute", "no-tuning", "fix-alpha", "useprops"):
        c.add_argument(f"--{name}", action="store_true")
    command(inspect, "hits").add_argument("--header", action="store_true")
    command(regroup, "hits", "out")
    command(offset, "gtf", "vcf", "out")
    command(hits_to_text, "hits", "out")
    command(hits_to_binary, "hits", "out")
    command(extract, "gtf", "fasta", "out")
    command(haplotypes, "fasta", "gff", "positions", "alleles", "out").add_argument("--pattern", default=src.HEADER)
    command(filter_gtf, "fasta", "gtf", "out")
    command(filter_fasta, "fasta", "pattern", "out").add_argument("--invert", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    session = spark or build()
    ship(session)
    a.run(session, a)


if __name__ == "__main__":
    main()
