"""Small cases worked by hand."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambiquant.functions import sequences as sq
from ambiquant.functions import statistics as st
from ambiquant.operators import alignments as al
from ambiquant.operators import classes as cl
from ambiquant.operators import intervals as iv
from ambiquant.operators import summaries as sm
from ambiquant.operators.selection import before, nth, with_rank
from ambiquant.plans import abundance, collapse, comparison
from ambiquant.session import cut
from ambiquant.sources import sequences as src


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="session")
def reads(spark):
    return spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["a", "b"]), ("r3", ["a"]), ("r4", ["b", "c"])], "read string, transcripts array<string>")


@pytest.fixture(scope="session")
def classes(reads):
    return cl.equivalence_classes(reads)


def test_classes_and_hits(spark, classes):
    assert rows(classes.select(F.array_join("members", ""), "k")) == [("a", 1), ("ab", 2), ("bc", 1)]
    assert rows(cl.unique_hits(classes)) == [("a", 1), ("b", 0), ("c", 0)]
    sets = spark.createDataFrame([("ab", "a"), ("ab", "b"), ("bc", "b"), ("bc", "c"), ("x", "z")], "set_id string, transcript string")
    assert rows(cl.contained_counts(classes, sets)) == [("ab", 3), ("bc", 1), ("x", 0)]


def test_components_and_regroup(spark, classes, reads):
    assert {r[1] for r in rows(cl.components(classes, cut))} == {"a"}
    genes = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "transcript string, gene string")
    assert rows(cl.regroup(reads, genes).select("read", F.array_join("transcripts", ""))) == [("r1", "g"), ("r2", "g"), ("r3", "g"), ("r4", "gh")]


def test_components_of_a_long_chain(spark):
    """120 classes in a row, in a random order of names, and a pair of its own."""
    names = [f"t{k:03d}" for k in np.random.default_rng(5).permutation(121)]
    chains = [("r%d" % k, sorted(names[k : k + 2])) for k in range(120)] + [("s", ["x", "y"])]
    chains += [("u%03d" % k, ["z%03d" % k, "z%03d" % (k + 1)]) for k in range(90)]
    got = cl.components(cl.equivalence_classes(spark.createDataFrame(chains, "read string, transcripts array<string>")), cut)
    want = [(n, "t000") for n in names] + [("x", "x"), ("y", "x")] + [("z%03d" % k, "z000") for k in range(91)]
    assert rows(got.select("transcript", "component")) == sorted(want)


def test_alignment_filters(spark):
    schema = "read string, transcript string, isize int, nm int, ordinal int"
    d = spark.createDataFrame([("r", "a", 200, 0, 1), ("r", "a", 170, 0, 2), ("r", "b", 300, 2, 3)], schema)
    assert len(rows(al.best_stratum(d))) == 2
    assert [r[2] for r in rows(al.one_per_feature(d, 180)) if r[1] == "a"] == [170]
    near = spark.createDataFrame([("r", "a", 180, 0, 1), ("r", "b", 300, 0, 2), ("s", "a", 300, 0, 3), ("s", "b", 400, 0, 4)], schema)
    assert [(r[0], r[2]) for r in rows(al.near_expected(near, 180, 49))] == [("r", 180), ("s", 300), ("s", 400)]
    assert len(rows(al.near_expected(near, 180, 19))) == 4


def test_mates_meet_by_number(spark):
    schema = "read string, transcript string, pos int, mpos int, nm int, isize int, ordinal int"
    rows_ = [("r", "a", 5, 9, 1, 50, 1), ("r", "a", 5, 9, 2, 51, 2), ("r", "a", 9, 5, 10, 50, 3), ("r", "a", 9, 5, 20, 49, 4), ("r", "a", 9, 5, 40, 48, 5)]
    rows_ += [("r", "b", 5, 9, 3, 7, 6), ("s", "a", 4, 4, 1, 8, 7), ("s", "a", 4, 4, 2, 9, 8), ("s", "a", 4, 4, 4, 1, 9), ("s", "a", 5, 4, 0, 0, 10)]
    got = al.pair_mates(spark.createDataFrame(rows_, schema)).select("read", "transcript", "left", "right", "nm", "isize", "n_mates")
    want = [("r", "a", 5, 9, 11, 50, 2), ("r", "a", 5, 9, 22, 51, 2), ("r", "a", 5, 9, 40, 48, 1), ("r", "b", 5, 9, 3, 7, 1), ("s", "a", 4, 4, 3, 9, 2), ("s", "a", 4, 4, 4, 1, 1), ("s", "a", 4, 5, 0, 0, 1)]
    assert rows(got) == sorted(want)


def test_em_properties(spark, classes):
    lengths = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.5)], "transcript string, l double")
    last = -math.inf
    for n in range(4):
        mu = abundance.em_fixed(classes, lengths, n)
        now = abundance.log_likelihood(classes, mu).first()[0]
        assert now >= last - 1e-9
        last = now
        assert abs(mu.agg(F.sum(F.col("mu") * F.col("l"))).first()[0] - 4) < 1e-9
    mu, course = abundance.em(classes, lengths, epsilon=1e-6, most=20)
    assert course == sorted(course)


def test_em_stops_at_the_first_small_gain(spark, classes):
    lengths = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.5), ("unseen", 1.0)], "transcript string, l double")
    mu, course = abundance.em(classes, lengths, epsilon=0.01)
    gains = np.diff(course)
    assert gains[-1] <= 0.01 and (gains[:-1] > 0.01).all() and len(rows(mu)) == 3
    plain = abundance.em_fixed(classes, lengths, len(gains), most_features=0)
    for x, y in zip(rows(mu), rows(plain)):
        assert x[0] == y[0] and abs(x[2] - y[2]) < 1e-12
    joined, other = abundance.em(classes, lengths, epsilon=0.01, most_features=0)
    assert len(other) == len(course) and abs(other[-1] - course[-1]) < 1e-9 and len(rows(joined)) == 3


def test_packed_classes(spark, classes):
    features = abundance.numbered(classes, spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.5)], "transcript string, l double"))
    assert [(r["transcript"], r["id"]) for r in features.orderBy("id").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    found = []
    for r in abundance.pack(classes, features.withColumn("component", F.lit("x")), 3).toArrow().to_batches():
        for ids, codes, sizes, k in abundance._arrays(r):
            for at, n, reads_ in zip(np.cumsum(sizes) - sizes, sizes, k):
                found.append((tuple(ids[codes[at : at + n]].tolist()), int(reads_)))
    assert sorted(found) == [((0,), 1), ((0, 1), 2), ((1, 2), 1)]


def test_gibbs_of_single_features_is_gamma(spark):
    """Two classes of one feature each: the posterior is a gamma distribution, in every component."""
    reads_ = [(f"r{i}", ["a"]) for i in range(50)] + [(f"s{i}", ["b"]) for i in range(7)]
    c = cl.equivalence_classes(spark.createDataFrame(reads_, "read string, transcripts array<string>"))
    lengths = spark.createDataFrame([("a", 2.0), ("b", 0.5)], "transcript string, l double")
    t = abundance.gibbs(c, lengths, iterations=1024, kept=1024)
    for f, k, l in (("a", 50, 2.0), ("b", 7, 0.5)):
        m = t.filter(F.col("feature") == f).agg(F.avg("value"), F.stddev("value"), F.count(F.lit(1)), F.count_distinct("iter")).first()
        assert abs(m[0] - (k + 0.1) / (l + 0.1)) < 5 * math.sqrt(k + 0.1) / (l + 0.1) / 32 and m[2] == m[3] == 1024
        assert abs(m[1] / (math.sqrt(k + 0.1) / (l + 0.1)) - 1) < 0.15
    assert rows(t) == rows(abundance.gibbs(c.repartition(3), lengths, iterations=1024, kept=1024))


def test_gibbs_of_one_component(spark):
    """Features of one length: their sum is gamma, whatever classes they share; chains agree and have tasks of their own."""
    rng = np.random.default_rng(3)
    reads_ = [(f"r{i}", sorted({f"f{x}" for x in rng.integers(0, 6, 3)})) for i in range(400)]
    c = cl.equivalence_classes(spark.createDataFrame(reads_, "read string, transcripts array<string>"))
    lengths = spark.createDataFrame([(f"f{x}", 1.5) for x in range(6)], "transcript string, l double")
    t = cut(abundance.gibbs(c, lengths, iterations=2048, kept=1024))
    total = t.groupBy("iter").agg(F.sum("value").alias("v")).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(total[0] - 400.6 / 1.6) < 5 * math.sqrt(400.6) / 1.6 / 32 and abs(total[1] / (math.sqrt(400.6) / 1.6) - 1) < 0.15
    rhat = [r["rhat"] for r in abundance.convergence(t).collect()]
    assert len(rhat) == 6 and max(rhat) < 1.2
    apart = t.withColumn("value", F.when(F.col("iter") < 512, F.col("value") * 9).otherwise(F.col("value")))
    assert min(r["rhat"] for r in abundance.convergence(apart).collect()) > 1.5
    with pytest.raises(ValueError):
        abundance.gibbs(c, lengths, iterations=100, kept=64)


def test_gibbs_keeps_totals_of_shared_classes():
    """Two classes of one size and one of another, in two blocks, none of a single feature: all reads are dealt in each sweep."""
    i = lambda *x: np.array(x, np.int32)
    c = abundance.Chain([[i(4, 7), i(0, 1), i(2), np.array([400])], [i(4, 7, 9), i(1, 2, 0, 1, 2), i(2, 3), np.array([300, 300])]], i(9, 4, 7), np.ones(3))
    t = c.draws(c.em(50), 64, 512, 1, 0.1, 0.1, np.random.default_rng(1))
    assert t.shape == (512, 3) and abs(t.sum(axis=1).mean() * 1.1 - 1000.3) < 6 and t[:, 1].mean() > t[:, 0].mean()


def test_sokal_matches_lag_sums():
    x = np.random.default_rng(1).normal(size=64).cumsum()
    var, tau, m = st.sokal(x)
    d = x - x.mean()
    c = np.array([(d * np.roll(d, k)).sum() for k in range(64)])
    assert abs(var - x.var(ddof=1)) < 1e-9
    assert abs(tau - (1 + 2 * (c[1:m] / c[0]).sum())) < 1e-9


def test_statistics(spark):
    assert abs(st.digamma(0.1) + 10.4237549404) < 1e-9 and abs(st.trigamma(0.1) - 101.4332991508) < 1e-9
    f = spark.createDataFrame([("x", 500), ("y", 10)], "transcript string, true_length int").withColumn("effective_length", F.lit(0.0))
    got = dict((r[0], r[1]) for r in st.effective_lengths(f).select("transcript", "effective_length").collect())
    assert abs(got["x"] - 321) < 1e-6 and got["y"] == 0.1
    v = spark.createDataFrame([([float(i) for i in range(1, 1025)],)], "values array<double>")
    assert v.select(sm.nearest_rank("values", 50)).first()[0] == 513


def test_special_functions(spark):
    x = np.concatenate([np.linspace(-37, 9, 301), [0.0, -0.7071, 0.7072, 1e-9]])
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(st.normal_cdf_array(x) / want - 1).max() < 1e-12
    got = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").select("x", st.normal_cdf(F.col("x")).alias("y")).collect()
    assert max(abs(r["y"] / w - 1) for r, w in zip(got, want)) < 1e-12 and got[-2]["y"] is None and math.isnan(got[-1]["y"])
    p = np.concatenate([10.0 ** np.linspace(-9, -0.31, 60), 1 - 10.0 ** np.linspace(-9, -0.31, 60), [0.5]])
    assert max(abs(a - NormalDist().inv_cdf(b)) for a, b in zip(st.quantiles(p), p)) < 1e-12
    y = np.concatenate([np.linspace(0.01, 30, 99), 10.0 ** np.linspace(1, 8, 20)])
    assert all(abs(a - math.lgamma(b)) < 1e-12 * max(1, abs(math.lgamma(b))) for a, b in zip(st.log_gamma(y), y))


def test_position_weights_equal_a_dense_solve(spark):
    """Newton's method with the rates of features as parameters of their own, on the whole matrix."""
    rng = np.random.default_rng(6)
    true = rng.normal(0, 0.15, (3, 41))
    seqs, counts, blocks, ys = [], [], [], []
    for f in range(5):
        code = rng.integers(0, 5 if f == 4 else 4, 700)
        near = np.lib.stride_tricks.sliding_window_view(code[1:], 41)[: 700 - 41]
        x = np.concatenate([near == k for k in range(3)], axis=1).astype(float)
        y = np.zeros(700, int)
        y[21 : 21 + len(x)] = rng.poisson(np.exp(x @ true.ravel()) * (2 + 3 * f))
        seqs.append("".join("ACGTN"[c] for c in code))
        counts.append(y.tolist())
        blocks.append(x)
        ys.append(y[21 : 21 + len(x)])
    d = spark.createDataFrame([*zip(seqs, counts), ("ACGT" * 50, [0] * 200), ("ACG", [9, 9, 9]), (None, [1])], "seq string, counts array<int>")
    weights, intercept, steps = st.fit_position_weights(d.repartition(4))
    x = np.hstack([np.vstack(blocks), np.repeat(np.eye(5), [len(b) for b in blocks], axis=0)])
    y, b = np.concatenate(ys), np.concatenate([np.zeros(123), np.log([v.mean() for v in ys])])
    for _ in range(60):
        mu = np.exp(x @ b)
        move = np.linalg.lstsq(x.T @ (x * mu[:, None]), x.T @ (y - mu), rcond=1e-10)[0]
        b += move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
    got = np.array([weights[c] for c in "ACG"])
    assert np.abs(got.ravel() - b[:123]).max() < 1e-6 and weights["T"] == [0.0] * 41 and steps < 20
    assert np.corrcoef(got.ravel(), true.ravel())[0, 1] > 0.8
    rates = np.exp(np.vstack(blocks) @ got.ravel() + intercept)
    assert abs(rates.mean() - 1) < 1e-9
    lengths = {r["seq"]: r["effective_length"] for r in st.positional_lengths(d, weights, intercept, 30).collect()}
    assert abs(sum(lengths[s] - 40 + 30 for s in seqs) / len(rates) - 1) < 1e-9 and lengths["ACG"] == 3 and lengths[None] == 0
    assert abs(st.positional_lengths(spark.createDataFrame([("A" * 100,)], "seq string"), [0.0] * 41, 0.0, 1, False).first()[1] - 99) < 1e-9


def test_sums_and_maxima_before_rows(spark):
    rng = np.random.default_rng(8)
    rows_ = [(None if k % 50 == 0 else "big" if k % 3 else f"k{k % 7}", int(p), k, None if k % 11 == 0 else int(v)) for k, (p, v) in enumerate(zip(rng.integers(0, 400, 900), rng.integers(-5, 9, 900)))]
    d = spark.createDataFrame(rows_, "key string, pos int, id int, v int").repartition(6)
    for how, plain in ((F.sum, sum), (F.max, max), (F.min, min)):
        got = {r["id"]: r["x"] for r in before(d, "key", ["pos", "id"], "v", how, "x").collect()}
        for key, p, k, _ in rows_:
            earlier = [v for a, b, c, v in rows_ if a == key and (b, c) < (p, k) and v is not None]
            assert got[k] == (plain(earlier) if earlier else None)


def boundaries_plainly(indels, bounds):
    """A boundary after the indels of its chromosome, one after another."""
    pending, out, shift, i = sorted(set(bounds)), {}, 0, 0
    for pos, ref, alt in sorted(indels):
        delta = len(alt) - len(ref)
        while i < len(pending) and pending[i] <= pos:
            out[pending[i]] = (pending[i] + shift,) * 2
            i += 1
        if delta < 0 and i < len(pending) and pending[i] <= pos - delta:
            out[pending[i]] = (pos + 1 + shift, pos + shift)
            i += 1
        shift += delta
    return out | {p: (p + shift,) * 2 for p in pending[i:]}


def test_islands_and_boundaries(spark):
    rng = np.random.default_rng(9)
    indels = [(c, int(p), "A" * int(rng.integers(1, 9)), "A" * int(rng.integers(1, 4))) for c in "xy" for p in sorted(set(rng.integers(1, 600, 120).tolist()))]
    indels += [("x", 700, "A" * 60, "A"), ("x", 710, "AAA", "A"), ("x", 730, "A", "AAA"), ("z", 5, "AAA", "A")]
    bounds = [(c, int(p)) for c in "xyw" for p in rng.integers(1, 800, 150)] + [("x", p) for p in (701, 705, 711, 712, 731, 760, 761)]
    got = iv.boundary_map(spark.createDataFrame(indels, "chrom string, pos int, ref string, alt string"), spark.createDataFrame(bounds, "chrom string, pos int"))
    want = {(c, p): v for c in "xyw" for p, v in boundaries_plainly([i[1:] for i in indels if i[0] == c and len(i[2]) != len(i[3])], [p for d, p in bounds if d == c]).items()}
    assert {(r["chrom"], r["pos"]): (r["new_left"], r["new_right"]) for r in got.collect()} == want
    kept, last = [], {}
    for c, p, ref, alt in sorted(indels):
        if p > last.get(c, -1):
            kept.append((c, p, ref, alt))
            last[c] = p + len(ref) - 1
    assert rows(iv.without_overlaps(spark.createDataFrame(indels, "chrom string, pos int, ref string, alt string").repartition(5))) == kept


def test_sequences(spark):
    one = spark.range(1)
    assert one.select(sq.reverse_complement(F.lit("ACGTN"))).first()[0] == "ACGT"
    assert one.select(src.wrapped(F.lit("ABCDEF"), 3)).first()[0] == "ABC\nDEF"
    f = spark.createDataFrame([("ENST123", "ENSG123", "ATCGAATGA", "+")], "transcript string, gene string, seq string, strand string")
    exons = spark.createDataFrame([("ENST123", 1000, 1003), ("ENST123", 1010, 1014)], "transcript_id string, start int, end int")
    points = spark.createDataFrame([("ENST123", 1003), ("ENST123", 1011)], "transcript_id string, pos int")
    at = sorted(r[0] for r in iv.spliced_positions(points, exons).select("at").collect())
    assert at == [3, 5]
    sites = spark.createDataFrame([("ENST123", at)], "transcript string, at array<int>")
    alleles = spark.createDataFrame([("ENST123_A", "GT"), ("ENST123_B", "CG")], "transcript_hap string, alleles string")
    assert rows(sq.haplotypes(f, sites, alleles).select("seq")) == [("ATCCAGTGA",), ("ATCGATTGA",)]


def test_offsets(spark):
    exons = spark.createDataFrame([("1", 100, 200), ("1", 300, 400)], "chrom string, start int, end int")
    indels = spark.createDataFrame([("1", 50, "AT", "A"), ("1", 298, "ATTT", "A")], "chrom string, pos int, ref string, alt string")
    assert rows(iv.offset_exons(exons, indels)) == [("1", 99, 199), ("1", 298, 396)]
    over = spark.createDataFrame([("1", 10, "AAAA", "A"), ("1", 12, "A", "AT"), ("1", 14, "A", "C")], "chrom string, pos int, ref string, alt string")
    assert [r[1] for r in rows(iv.without_overlaps(over))] == [10, 14]


def test_header_and_polyclass(spark):
    h = spark.createDataFrame([("transcript1234 gene567|chr1|1234",)], "header string")
    assert rows(src.header_ids(h, r"(\S+) ([^\|]+)\|.*").select("transcript", "gene")) == [("transcript1234", "gene567")]
    p = sm.polyclass(spark.createDataFrame([("f", [2.0, 3.0]), ("g", [float("inf"), 1.0])], "feature string, bf array<double>"), [0.5, 0.25, 0.25])
    got = dict((r[0], list(r[1])) for r in p.collect())
    assert got["g"] == [0, 1, 0] and abs(sum(got["f"]) - 1) < 1e-12


def test_designs_and_comparison(spark):
    g = comparison.two_groups(2, 2)
    assert g.p[1].ravel().tolist() == [0.5, 0.5, -0.5, -0.5] and g.c[0].tolist() == [0, 0, 0, 0]
    assert comparison.two_groups(3, 3, 2).p[1].shape == (8, 3)
    rng = np.random.default_rng(2)
    y = rng.normal(3, 0.2, (8, 6))
    y[:4, 3:] += 3
    names = [f"s{i}" for i in range(6)]
    long = spark.createDataFrame([(f"f{i}", n, float(y[i, k]), 0.1) for i in range(8) for k, n in enumerate(names)], "feature string, sample string, y double, e double")
    r = comparison.compare(long, names, comparison.two_groups(3, 3), burnin=512, iterations=512, tune_batches=8)
    pp = {x["feature"]: x["posterior_probability"] for x in r.collect()}
    assert min(pp[f"f{i}"] for i in range(4)) > 0.5 > max(pp[f"f{i}"] for i in range(4, 8))


def test_tuning_goes_on_until_features_are_tuned(spark):
    rng = np.random.default_rng(4)
    names = [f"s{i}" for i in range(10)]
    y = rng.normal(0, 0.1, 10) + np.where(np.arange(10) < 5, 40.0, 0.0)
    long = spark.createDataFrame([("f", n, float(v), 0.1) for n, v in zip(names, y)], "feature string, sample string, y double, e double")
    run = lambda **k: comparison.compare(long, names, comparison.two_groups(5, 5), burnin=512, iterations=1024, **k).first()
    whole = run()
    assert whole["tuned"] and math.isfinite(whole["bayes_factor"]) and whole["bayes_factor"] > math.exp(14)
    assert not run(tune_batches=64)["tuned"]


def test_comparison_does_not_depend_on_batch_mates(spark):
    rng = np.random.default_rng(7)
    names = [f"s{i}" for i in range(6)]
    y = rng.normal(0, 0.3, (6, 6)) + np.outer(np.arange(6) * 2.0, np.arange(6) > 2)
    long = spark.createDataFrame([(f"f{i}", n, float(y[i, k]), 0.1) for i in range(6) for k, n in enumerate(names)], "feature string, sample string, y double, e double")
    run = lambda d, **k: {r["feature"]: r for r in comparison.compare(d.coalesce(1), names, comparison.two_groups(3, 3), burnin=256, iterations=512, **k).collect()}
    whole, alone = run(long), run(long, batch=1)
    for f, r in whole.items():
        assert abs(r["alpha1"] - alone[f]["alpha1"]) < 1e-6 or math.isnan(r["alpha1"])
        assert abs(r["posterior_probability"] - alone[f]["posterior_probability"]) < 1e-6


def test_counter_based_draws():
    """Moments and quantiles of each kind, independence of neighbours, and rows that do not depend on others."""
    keys = np.array([comparison.key_of(1, f"f{k}") for k in range(400)], np.uint64)
    d = comparison.Draws(keys, np.zeros(400, np.uint64))
    d.next_sweep()
    u, z = d.draw("u", 50), d.draw("n", 50)
    assert 0 < u.min() and u.max() < 1 and np.abs(np.histogram(u, 20, (0, 1))[0] / 1000 - 1).max() < 0.15
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.02 and abs((z**4).mean() - 3) < 0.2
    assert abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.03 and abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.03
    a = np.tile([0.3, 1.0, 2.5, 40.0], (400, 20))
    g = d.draw("g", 80, a=a)
    for k in range(4):
        x = g[:, k::4]
        assert abs(x.mean() / a[0, k] - 1) < 0.05 and abs(x.var() / a[0, k] - 1) < 0.12
    one = comparison.Draws(keys[7:9], np.zeros(2, np.uint64))
    one.next_sweep()
    assert (one.draw("u", 50) == u[7:9]).all() and (one.draw("n", 50) == z[7:9]).all() and (one.draw("g", 80, a=a[7:9]) == g[7:9]).all()
    d.next_sweep()
    assert abs(np.corrcoef(d.draw("u", 50).ravel(), u.ravel())[0, 1]) < 0.03


def test_bayes_factors_agree_with_integration(spark):
    """Means and coefficients are integrated out exactly, variances by draws from their priors."""
    rng = np.random.default_rng(12)
    y = np.array([[0.1, -0.2, 0.05, 1.1, 0.9, 1.3], [0.3, 0.1, -0.4, 0.2, -0.1, 0.3]])
    e = np.full((2, 6), 0.2)
    n, g = 400_000, comparison.two_groups(3, 3)
    rho = rng.gamma(comparison.Q, 1 / comparison.R, n)
    want = []
    for f in range(2):
        marginal = []
        for m in (0, 1):
            classes = int(g.c[m].max()) + 1
            s2 = (comparison.K * rho[:, None] / 2) / rng.gamma(comparison.K / 2, 1, (n, classes))
            lam = 2.0 / rng.gamma(1.4, 1, n)
            var = e[f] ** 2 + s2[:, g.c[m]]
            cols = [(np.ones(6), np.full(n, comparison.V_ALPHA))] + ([(g.p[1][:, 0], lam)] if m else [])
            log = -0.5 * (np.log(2 * np.pi * var) + y[f] ** 2 / var).sum(1)
            # one normal coefficient after another is integrated out of the precision matrix
            a = np.zeros((n, len(cols), len(cols)))
            b = np.zeros((n, len(cols)))
            for i, (x, v) in enumerate(cols):
                b[:, i] = (x * y[f] / var).sum(1)
                log -= 0.5 * np.log(v)
                for j, (w, _) in enumerate(cols):
                    a[:, i, j] = (x * w / var).sum(1) + (1 / v if i == j else 0)
            log += -0.5 * np.log(np.linalg.det(a)) + 0.5 * np.einsum("ni,ni->n", b, np.linalg.solve(a, b[..., None])[..., 0])
            marginal.append(np.exp(log).mean())
        want.append(marginal[1] / marginal[0])
    long = spark.createDataFrame([(f"f{i}", f"s{k}", float(y[i, k]), 0.2) for i in range(2) for k in range(6)], "feature string, sample string, y double, e double")
    got = {r["feature"]: r for r in comparison.compare(long, [f"s{k}" for k in range(6)], g, burnin=2048, iterations=16384).collect()}
    for i in range(2):
        assert got[f"f{i}"]["tuned"] and abs(math.log(got[f"f{i}"]["bayes_factor"] / want[i])) < 0.2, (i, got[f"f{i}"]["bayes_factor"], want[i])


def test_common_set_and_bound_factors(spark):
    t = spark.createDataFrame([("a_A", 1), ("b_A", 2)], "feature string, x int")
    names = spark.createDataFrame([("b", 1), ("z", 2), ("a", 3)], "feature string, ordinal int")
    assert [tuple(r) for r in sm.common_set(t, names, "_A$").collect()] == [(1, "b", 2), (2, "z", None), (3, "a", 1)]
    b = lambda *v: spark.createDataFrame(list(v), "feature string, bayes_factor double")
    assert rows(sm.bound_factors([b(("f", 2.0), ("g", 1.0)), b(("g", 4.0), ("f", 3.0))])) == [("f", [2.0, 3.0]), ("g", [1.0, 4.0])]


def test_coverage_ranking(spark):
    f = spark.createDataFrame([("a", "g", 10, 1), ("b", "g", 10, 2), ("c", "h", 10, 3), ("d", "i", 10, 4)], "transcript string, gene string, length int, ordinal int")
    n = spark.createDataFrame([("a", 5), ("b", 9), ("c", 7), ("d", 1)], "transcript string, n int")
    assert [r[0] for r in rows(sm.coverage_ranking(n, f, 2))] == ["a", "c"]
    assert [r[0] for r in rows(sm.coverage_ranking(n, f, 1))] == ["b", "c"]
    assert [r[0] for r in rows(sm.coverage_ranking(n, f, 9))] == ["a", "c", "d"]


def merge_plainly(names, covariance, observed, bound):
    """By the whole matrix: the smallest mean correlation of all pairs, again and again.  covariance: samples by features by features."""
    r, sets, live, n = covariance.copy(), [[x] for x in names], [True] * len(names), len(names)

    def mean(a, b):
        got = []
        for s in range(len(r)):
            if observed[a, s] and observed[b, s]:
                d = math.sqrt(max(r[s, a, a], 0)) * math.sqrt(max(r[s, b, b], 0))
                got.append(r[s, a, b] / d if d > 0 else 0.0)
        return sum(got) / len(got) if got else math.inf

    while True:
        best = min(((mean(a, b), a, b) for a in range(n) for b in range(a + 1, n) if live[a] and live[b]), default=(math.inf,))
        if best[0] >= bound:
            return [s for k, s in enumerate(sets) if live[k]]
        _, a, b = best
        r[:, a, :] += r[:, b, :]
        r[:, :, a] += r[:, :, b]
        sets[a], live[b] = sorted(sets[a] + sets[b]), False


def sparse(cov):
    i, j = np.nonzero(np.triu(np.abs(cov).sum(axis=0), 1))
    return i, j, cov[:, i, j].T, np.stack([np.diag(c) for c in cov], axis=1)


def test_collapse_merges_anticorrelated():
    x = np.random.default_rng(3).normal(size=(3, 500))
    cov = np.cov(np.stack([x[0], -x[0] + 0.1 * x[1], x[2]]))[None]
    assert collapse.merge_greedily(["a", "b", "c"], *sparse(cov), np.ones((3, 1), bool), -0.5) == [["a", "b"], ["c"]]
    with pytest.raises(ValueError):
        collapse.merge_greedily(["a"], *sparse(np.ones((1, 1, 1))), np.ones((1, 1), bool), 0.1)


def test_heap_merges_as_the_whole_matrix_does():
    rng = np.random.default_rng(11)
    for t in range(30):
        n, samples = int(rng.integers(1, 14)), int(rng.integers(1, 4))
        x = rng.integers(-3, 4, (samples, n, 12)).astype(float)
        x[:, ::3] *= rng.random() < 0.8
        cov = np.stack([np.atleast_2d(np.cov(v)) for v in x])
        linked = rng.random((n, n)) < 0.5
        linked = (linked | linked.T) | np.eye(n, dtype=bool)
        cov = np.where(linked, cov, 0.0)
        observed = rng.random((n, samples)) < 0.8
        names, bound = [f"f{k:02d}" for k in range(n)], float(rng.choice([-0.7, -0.3, -0.05, 0.0]))
        assert collapse.merge_greedily(names, *sparse(cov), observed, bound) == merge_plainly(names, cov, observed, bound), t


def test_sparse_covariances_and_collapse(spark):
    """Tiles of several parts, features that a sample or some iterations lack, pairs without shared reads."""
    rng = np.random.default_rng(5)
    n = 700
    base = rng.normal(size=(n // 2, 30))
    x = np.empty((n, 30))
    x[::2], x[1::2] = base, -base + 0.3 * rng.normal(size=base.shape)
    lines = [("s", f"f{k:03d}", i, float(x[k, i])) for k in range(n) for i in range(30) if (k + i) % 17] + [("t", f"f{k:03d}", i, float(k + i * i % 7)) for k in range(0, n, 3) for i in range(5)]
    traces = spark.createDataFrame(lines, "sample string, feature string, iter int, value double")
    own = [(f"c{k}", f"f{m:03d}") for k in range(n) for m in (k, (k + 1) % n, (k * 7) % n)]
    pairs = collapse.sharing(spark.createDataFrame(own, "class_id string, feature string"))
    want = {tuple(sorted((a, b))) for k in range(n) for t in [[m for c, m in own[3 * k : 3 * k + 3]]] for a in t for b in t if a != b}
    assert {tuple(r) for r in pairs.collect()} == want
    groups = spark.createDataFrame([(f"f{k:03d}", "g") for k in range(n)], "feature string, component string")
    got = collapse.covariances(traces, pairs, groups).collect()
    held = {}
    for s, f, i, v in lines:
        held.setdefault((s, f), {})[i] = v
    assert {(r["sample"], r["a"], r["b"]) for r in got} == {(s, a, b) for s in "st" for a, b in want if (s, a) in held and (s, b) in held}
    for r in got[::7]:
        u, v = held[r["sample"], r["a"]], held[r["sample"], r["b"]]
        both = sorted(set(u) & set(v))
        c = np.cov([u[i] for i in both], [v[i] for i in both])
        assert abs(r["cov"] - c[0, 1]) < 1e-9 and (r["corr"] is None or abs(r["corr"] - c[0, 1] / math.sqrt(c[0, 0] * c[1, 1])) < 1e-9)
    # merged sets against the whole matrix
    keep = [f"f{k:03d}" for k in range(24)]
    at = {f: k for k, f in enumerate(keep)}
    var = {(r["sample"], r["feature"]): r["v"] for r in traces.groupBy("sample", "feature").agg(F.var_samp("value").alias("v")).collect()}
    cov, seen = np.zeros((2, 24, 24)), np.zeros((24, 2), bool)
    for (s, f), v in var.items():
        if f in at:
            cov["st".index(s), at[f], at[f]], seen[at[f], "st".index(s)] = v, True
    inside = [r for r in got if r["a"] in at and r["b"] in at]
    for r in inside:
        cov["st".index(r["sample"]), at[r["a"]], at[r["b"]]] = cov["st".index(r["sample"]), at[r["b"]], at[r["a"]]] = r["cov"]
    few = spark.createDataFrame([(r["sample"], r["a"], r["b"], r["cov"]) for r in inside], "sample string, a string, b string, cov double")
    variances = traces.filter(F.col("feature").isin(keep)).groupBy("sample", "feature").agg(F.var_samp("value").alias("var"))
    merged = collapse.collapse(few, variances, groups, -0.4).collect()
    assert sorted(r["members"] for r in merged) == sorted(merge_plainly(keep, cov, seen, -0.4)) and any(len(r["members"]) > 1 for r in merged)


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    v = {"a": rng.normal(size=3000).tolist(), "b": [1.0] * 500 + [2.0] * 3, "c": [5.0], "d": rng.integers(0, 9, 2000).astype(float).tolist()}
    d = spark.createDataFrame([(g, x) for g, xs in v.items() for x in xs] + [("a", None), ("e", None)], "g string, x double").repartition(5)
    for share in (0.0, 0.37, 0.999):
        got = {r["g"]: (r["n"], r["nth"]) for r in nth(d, ["g"], "x", lambda n: F.floor(n * share)).collect()}
        assert got == {g: (len(xs), sorted(xs)[int(len(xs) * share)]) for g, xs in v.items()}
    every = sorted(x for xs in v.values() for x in xs)
    assert nth(d, [], "x", lambda n: F.floor(n / 2)).first()["nth"] == every[len(every) // 2]
    assert nth(d, [], "x", lambda n: n).count() == 0 and nth(d.limit(0), [], "x", lambda n: n * 0).count() == 0
    names = spark.createDataFrame([(f"n{k % 800:03d}", k) for k in range(1500)], "name string, k int").repartition(7)
    ranked = with_rank(names, "name", "k").collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: (r["name"], r["k"]))] == list(range(1500))


def test_permutation_keeps_values(spark):
    long = spark.createDataFrame([("f", f"s{i}", float(i), 0.1, 1) for i in range(6)], "feature string, sample string, y double, e double, uh int")
    p = sm.permuted(long, 3)
    assert sorted(r["y"] for r in p.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert rows(p) == rows(sm.permuted(long.repartition(3), 3))


def test_covariances_of_classes_copy_traces_little(spark):
    """A component's traces go to few tiles; means and packed arrays tell the same; repeated lines and pairs count once."""
    names = spark.range(5000).select(F.col("id").alias("feature"), F.lit(0).alias("component"))
    few = spark.range(5000).select(F.lit("s").alias("sample"), F.col("id").alias("feature"), F.lit(0).alias("iter"), F.lit(1.0).alias("value"))
    assert collapse.parts_of(names, few).select("part").distinct().count() == 2
    rng = np.random.default_rng(8)
    lines = [(s, f, int(i), float(rng.integers(1, 50))) for s in "st" for f in range(40) for i in range(int(rng.integers(1, 9)) + (3000 if f == 0 else 0))]
    traces = spark.createDataFrame(lines, "sample string, feature bigint, iter int, value double")
    inc = spark.createDataFrame([(int(c), int(f)) for c in range(90) for f in rng.integers(0, 42, 3)] * 2, "class_id bigint, feature bigint")
    pairs = collapse.sharing(inc)
    groups = spark.createDataFrame([(f, 0) for f in range(42)], "feature bigint, component int")
    want = sorted(rows(collapse.covariances(traces, pairs, groups)), key=repr)
    assert sorted(rows(collapse.covariances_of_classes(traces, inc, groups)), key=repr) == want and len(want) > 100
    mean = {(r[0], r[1]): r[2:] for r in rows(collapse.mean_correlations(collapse.covariances(traces, pairs, groups)))}
    got = {(r[0], r[1]): r[2:] for r in rows(collapse.covariances_of_classes(traces, inc, groups, mean=True))}
    assert got.keys() == mean.keys() and all(np.allclose(got[k], mean[k], atol=1e-12) for k in got)
    packed = collapse.covariances_of_classes(traces, inc, groups, packed=True).collect()
    flat = sorted((r["sample"], a, b, c) for r in packed for a, b, c in zip(r["a"], r["b"], r["cov"]))
    assert flat == sorted((s, a, b, c or 0.0) for s, a, b, c, _ in want)


def test_uneven_rows_are_looked_up():
    rng = np.random.default_rng(4)
    at = [np.sort(rng.choice(2_000_000 if k == 0 else 60, 40, replace=False)) for k in range(30)]
    values = [rng.integers(0, 9, 40).astype(float) for _ in at]
    i, j = np.triu_indices(30, 1)
    got = collapse._sums(np.full(30, 40), np.concatenate(at), np.concatenate(values), j, i)
    for k in range(len(i)):
        u, v = dict(zip(at[j[k]], values[j[k]])), dict(zip(at[i[k]], values[i[k]]))
        x, y = (np.array([z[t] for t in u if t in v]) for z in (u, v))
        assert got[:, k].tolist() == [len(x), x.sum(), y.sum(), x @ y, x @ x, y @ y]


def test_connected_follows_what_two_edges_leave_open(spark):
    """Graphs in which the least and the largest hub of each feature don't connect all that is connected."""
    rng = np.random.default_rng(6)
    for _ in range(2):
        edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k) for k in range(60)] + [(x, 100) for x in (100, 101, 102, 103, 104)] + [(x, x) for x in (101, 102, 103, 104)]
        root = {x: x for e in edges for x in e}
        for _ in range(len(root)):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        assert dict(rows(cl.connected(spark.createDataFrame(edges, "a bigint, b bigint"), cut))) == root


def test_overlaps_have_no_call_an_island(spark):
    d = spark.range(3000).select(F.lit("c").alias("chrom"), (F.col("id") * 3).cast("int").alias("pos"), F.expr("repeat('A', CAST(1 + id % 5 AS INT))").alias("ref"), F.lit("A").alias("alt"))
    kept = iv.without_overlaps(d)
    assert "FlatMapGroups" not in kept._jdf.queryExecution().toString()
    want, last = [], -1
    for k in range(3000):
        if 3 * k > last:
            want.append(3 * k)
            last = 3 * k + k % 5
    assert sorted(r["pos"] for r in kept.collect()) == want


def test_gibbs_arrays_are_its_traces(spark):
    """By chains, and by whole components without a shuffle of traces."""
    c = cl.equivalence_classes(spark.createDataFrame([(str(k), t) for k, t in enumerate([["a", "b"]] * 9 + [["b"]] * 4 + [["c"]] * 5 + [["d", "e", "f"]] * 7)], "read string, transcripts array<string>"))
    lengths = spark.createDataFrame([(x, 1.0) for x in "abcdef"], "transcript string, l double")
    t = cut(abundance.gibbs(c, lengths, iterations=1024, kept=512))
    held = {}
    for f, i, v in t.collect():
        held.setdefault(f, {})[i] = v
    want = {f: [x[i] for i in range(512)] for f, x in held.items()}
    rhat = dict(rows(abundance.convergence(t, kept=512)))
    for whole in (1 << 25, 2 * 512, 0):
        got = abundance.gibbs_arrays(c, lengths, iterations=1024, kept=512, whole=whole).withColumn("rhat", abundance.convergence_of(F.col("values"))).collect()
        assert {r["feature"]: r["values"] for r in got} == want and all(abs(r["rhat"] - rhat[r["feature"]]) < 1e-9 for r in got)


def test_gibbs_is_summarised_where_it_is_drawn(spark):
    """No trace leaves the task that drew its component; a large component's chains send their draws in pieces."""
    c = cl.equivalence_classes(spark.createDataFrame([(str(k), t) for k, t in enumerate([["a", "b"]] * 9 + [["b"]] * 4 + [["c"]] * 5 + [["d", "e", "f"]] * 7)], "read string, transcripts array<string>"))
    lengths = spark.createDataFrame([(x, 1.0) for x in "abcdef"], "transcript string, l double")
    t = cut(abundance.gibbs(c, lengths, iterations=1024, kept=512))
    want = {r["feature"]: r for r in sm.summarise(t).join(abundance.convergence(t, kept=512), "feature").collect()}
    for whole in (1 << 25, 2 * 512, 20):
        found = abundance.gibbs_summaries(c, lengths, iterations=1024, kept=512, whole=whole)
        got = {r["feature"]: r for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[f][x] / want[f][x] - 1) < 1e-9 for f in want for x in ("log_mu", "sd", "mcse", "iact", "rhat"))
    _, rows_of, draw = abundance._chains(c, lengths, 1024, 512, 0.1, 0.1, None, 1, 200, 8)
    sent = abundance._by_chain(rows_of, draw, 8, 20).select(F.size("values").alias("n"), "first").collect()
    assert max(r["n"] for r in sent) <= 20 and max(r["first"] for r in sent) > 0 and sum(r["n"] for r in sent) == 6 * 512


def test_draws_are_those_of_sums_by_class():
    """Classes drawn in pieces take the same random numbers as all of a size at once."""
    rng = np.random.default_rng(2)
    codes = [np.sort(rng.choice(50, s, replace=False)).astype(np.int32) for s in (3, 2, 3, 3, 2, 4) * 1500]
    c = abundance.Chain([[np.arange(50, dtype=np.int32), np.concatenate(codes), np.array([len(x) for x in codes], np.int32), np.ones(len(codes), np.int64)]], np.arange(50, dtype=np.int32), np.ones(50))
    one, mu = np.random.default_rng(7), np.full(50, 2.0) + np.arange(50)
    x = np.zeros(50)
    for size in (2, 3, 4):
        at = np.array([z for z in codes if len(z) == size])
        upto = np.cumsum(mu[at], axis=1)
        x += np.bincount(at[np.arange(len(at)), ((one.random(len(at)) * upto[:, -1])[:, None] >= upto[:, :-1]).sum(axis=1)], minlength=50)
    assert (c.draws(mu, 0, 1, 1, 0.1, 0.1, np.random.default_rng(7))[0] == np.maximum(one.gamma(0.1 + x, np.full(50, 1 / 1.1)), 1e-300)).all()


def test_pairs_of_classes_are_made_in_their_tiles(spark, monkeypatch):
    """No pair is shuffled, a component of one part has its traces once, and pairs come some at a time; parts of a component tell the same."""
    rng = np.random.default_rng(12)
    lines = [("st"[i % 2], f, i, float(rng.integers(1, 50))) for f in range(60) for i in range(int(rng.integers(1, 12)))]
    traces = spark.createDataFrame(lines, "sample string, feature bigint, iter int, value double")
    inc = spark.createDataFrame([(int(c), int(f)) for c in range(120) for f in rng.integers(0, 62, 4)], "class_id bigint, feature bigint")
    groups = spark.createDataFrame([(f, f // 61) for f in range(62)], "feature bigint, component int")
    pairs = collapse.sharing(inc).filter("b < 61")
    want = sorted(rows(collapse.covariances(traces, pairs, groups)), key=repr)
    found = collapse.covariances_of_classes(traces, inc, groups)
    assert sorted(rows(found), key=repr) == want and len(want) > 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "classes" in plan and "(a#" not in plan and "FlatMapCoGroups" not in plan
    for values in (40, 90):
        monkeypatch.setattr(collapse, "VALUES", values)
        assert collapse.parts_of(groups, traces, collapse.WIDE).select("part").distinct().count() > 2
        assert sorted(rows(collapse.covariances_of_classes(traces, inc, groups)), key=repr) == want
    monkeypatch.setattr(collapse, "PAIRS", 20)
    feature, of = (np.array([r[k] for r in inc.collect()]) for k in (1, 0))
    steps = [list(zip(i.tolist(), j.tolist())) for i, j in collapse._pairs(feature, of, 62)]
    assert sorted(sum(steps, [])) == sorted(rows(collapse.sharing(inc))) and len(steps) > 20


def test_components_by_classes(spark):
    """Classes beyond the least and largest of each feature join components, too; names and repeated rows don't matter."""
    rng = np.random.default_rng(13)
    for n in (70, 90):
        inc = [(int(c), int(f)) for c, f in zip(rng.integers(0, n, 2 * n), rng.integers(0, 80, 2 * n))] + [(200 + k, 100 + (k + j) % 9) for k in range(9) for j in (0, 0, 1)] + [(300, 140), (301, 140), (301, 141), (302, 140), (302, 150), (303, 141), (303, 151), (304, 141)]
        edges = [(min(f for k, f in inc if k == c), m) for c, m in inc]
        want = rows(cl.connected(spark.createDataFrame(edges, "a bigint, b bigint"), cut))
        assert rows(cl.connected_by_classes(spark.createDataFrame(inc, "class_id bigint, transcript bigint").repartition(3), cut)) == want


def test_components_of_one_part_are_merged_in_their_tile(spark, monkeypatch):
    """The same sets as from pairs, whether a component has one part or several; traces have the classes of their values."""
    rng = np.random.default_rng(14)
    lines = [("st"[i % 2], f, i, float(rng.integers(1, 50)), int(rng.integers(0, 90)) + 1000 * (f // 30)) for f in range(60) for i in range(int(rng.integers(2, 14)))]
    traces = spark.createDataFrame(lines, "sample string, feature bigint, iter int, value double, class_id bigint").repartition(3)
    inc = traces.select("class_id", "feature")
    groups = spark.createDataFrame([(f, f // 30) for f in range(60)], "feature bigint, component int")
    same = lambda x, y: sorted(rows(x), key=repr) == sorted(rows(y), key=repr)
    assert same(collapse.covariances_of_classes(traces, None, groups), collapse.covariances_of_classes(traces, inc, groups))
    pairs = collapse.covariances(traces, collapse.sharing(inc), groups)
    variances = traces.groupBy("sample", "feature").agg(F.var_samp("value").alias("var"))
    want = collapse.collapse(pairs, variances, groups, -0.3)
    assert len(rows(want)) < 50
    found = collapse.collapse_classes(traces, groups, -0.3)
    assert same(found, want) and "cov" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(collapse, "VALUES", 60)
    assert same(collapse.collapse_classes(traces, groups, -0.3), want)


def test_lines_are_shuffled_once_for_traces(spark, tmp_path):
    """Traces and their classes are dealt by part once, without a column twice."""
    spark.createDataFrame([(k % 7, k % 5, 1, k, float(k)) for k in range(60)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    from ambiquant.plans import proxy

    plan = collapse._vectors(proxy._two_samples(spark, str(tmp_path)), True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.split("Exchange hashpartitioning")[1].split("Project [")[1].split("\n")[0].count(",") == 4
