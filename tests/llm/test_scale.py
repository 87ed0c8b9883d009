"""Rows that weigh much: frequent phrases, long conversations, long texts, weights of any scale."""

import random
import time

import brute
import numpy as np
from pyspark.sql import functions as F

from ambiquant.llm import chat, jaccard_join, mixing, quality, suffix_dedup, topk, toxicity
from ambiquant.llm.blocks import mix64


def test_hotter_anchors(spark):
    """A phrase in more documents than HOTTER, in unlike surroundings: its windows are dealt over all buckets, and none is lost."""
    rnd = random.Random(4)
    phrase = "".join(rnd.choice("abcdefgh ") for _ in range(44))
    letters = "abcdefghijklmnopqrstuvwxyz "
    rows = [(i, "".join(rnd.choice(letters) for _ in range(22)) + phrase + "".join(rnd.choice(letters) for _ in range(12)) + ("tail" if i % 3 else phrase)) for i in range(4400)]
    rows += [(5000 + i, rows[i][1][3:]) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(repr, brute.removal_digest(rows))) == sorted(repr(tuple(r)) for r in suffix_dedup.digest(d).collect())
    block = suffix_dedup.Block([r[0] for r in rows], [r[1] for r in rows])
    order = np.argsort(block.anchor, kind="stable")
    anchors = block.anchor[order][suffix_dedup.group_starts(block.anchor[order])]
    n = np.array([np.count_nonzero(block.anchor == a) for a in anchors])
    key = np.where(n >= suffix_dedup.HOTTER, anchors | np.uint64(1 << 63) | np.uint64(1), np.where(n > 1, mix64(anchors) >> np.uint64(33), np.uint64(0)))
    assert (n >= suffix_dedup.HOTTER).any()
    by, texts, _ = block.strings({0: key.tobytes()}, 100)
    sizes = np.array([sum(len(texts[i]) for i in by.get(b, [])) for b in range(100)])
    # anchors below HOTTER stay whole
    assert sizes.max() < 2 * sizes.mean() + 2 * suffix_dedup.HOTTER * suffix_dedup.SPAN and np.median(sizes) > sizes.mean() / 2


def test_ranges_do_not_depend_on_the_scale_of_weights(spark):
    d = spark.range(200_000).select(F.explode(F.array(*[F.lit(w) for w in (0.001, 1.0, 100.0)])).alias("w"), (-F.log((F.col("id") + 0.5) / 200_000)).alias("x"))
    counts = d.groupBy("w", mixing.range_of(F.col("x") / F.col("w"), 4096).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("x") / F.col("w")).alias("lo"), F.max(F.col("x") / F.col("w")).alias("hi")).collect()
    assert max(r["n"] for r in counts) < 3 * 200_000 / 4096
    for w in (0.001, 1.0, 100.0):
        own = sorted((r["r"], r["lo"], r["hi"]) for r in counts if r["w"] == w)
        assert all(a[2] < b[1] for a, b in zip(own, own[1:]))


def test_long_conversations(spark):
    """The digest of long turns, read back, and its time as turns double."""
    said = ["line\n" * 30 + "<x> </turn> \\ <turn:user>\n", "", "plain " * 40]
    rows = [(c, t, ["user", "assistant", "<r>"][t % 3], said[(t + c) % 3]) for c, n in ((1, 900), (2, 3), (3, 1)) for t in range(n)] + [(None, 0, "assistant", "of no conversation"), (4, 0, None, None)]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(d)).collect()}
    for c in (1, 2, 3, 4, None):
        own = [r for r in rows if r[0] == c]
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want = (len(own), brute.hashlib.sha256(text.encode()).hexdigest(), len(loss), brute.hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
    took = []
    for n in (20_000, 40_000):
        one = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("some words "), 20).alias("text"))
        began = time.time()
        assert chat.digest(chat.format_conversations(one)).first()["n_turns"] == n
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 2


def test_a_span_that_is_no_body_is_an_error(spark):
    d = chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", "abc")], "conv_id bigint, turn bigint, role string, text string"))
    off = d.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["len"].alias("len"))))
    try:
        chat.digest(off).collect()
    except Exception as e:
        assert "no turn's body" in str(e)
    else:
        raise AssertionError("no error")


def test_long_texts_are_scored_in_stretches():
    rnd = random.Random(6)
    model = toxicity.Model(slots=1000)
    for n in (0, 1, 2, 5, 60_000):
        text = " ".join(rnd.choice(["alpha", "Beta,", "gamma\n", "ΟΔΟΣ", "x" * 50]) + str(rnd.randrange(300)) for _ in range(n)) + " end" * (n % 2)
        assert "".join(toxicity.stretches(text)) == text
        whole = model.scores([toxicity.word_ids(text, model.slots)])[0]
        assert abs(model.score_of_long(text) - whole) < 1e-6
    words = [rnd.randrange(1000) for _ in range(50)]
    for sizes in ([50], [1] * 50, [3, 0, 40, 7], [49, 1]):
        parts, at = [], 0
        for k in sizes:
            parts.append(words[at : at + k])
            at += k
        assert abs(model.logit_of_long(iter(parts)) - model.logits([words])[0]) < 1e-5


def test_cells_of_cells_give_each_linked_pair_once(monkeypatch):
    """Clusters, a chain and unlike sets in one region, with repeated sets; most pairs never meet."""
    rng = np.random.default_rng(8)
    sets = []
    for c in range(12):
        base = rng.choice(10**6, 60, replace=False)
        for _ in range(20):
            sets.append(np.unique(np.where(rng.random(60) < rng.choice([0, 0.03, 0.1, 0.14]), rng.integers(0, 10**6, 60), base)))
    chain = rng.choice(10**6, 400, replace=False)
    sets += [np.unique(chain[3 * k : 3 * k + 60]) for k in range(100)] + [np.unique(rng.integers(0, 300, 40)) for _ in range(40)]
    sets = [sets[i].astype(np.uint64) for i in rng.permutation(len(sets))]
    want = set()
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                want.add((j, i))
    divided, compared = [], []
    real, similar = jaccard_join.voronoi, jaccard_join.Region.similar
    monkeypatch.setattr(jaccard_join, "voronoi", lambda r: divided.append(len(r.n)) or real(r))
    monkeypatch.setattr(jaccard_join.Region, "similar", lambda self, own, size, lo, hi: compared.append(hi - lo) or similar(self, own, size, lo, hi))
    found = [tuple(sorted((i, j))) for i, near in jaccard_join.linked_pairs(jaccard_join.Region(sets)) for j in near.tolist()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 1000
    assert len(divided) > 5 and sum(compared) < len(sets) ** 2 / 4


def test_linked_pairs_of_one_set_and_of_equal_sets():
    one = np.arange(5, dtype=np.uint64)
    assert list(jaccard_join.linked_pairs(jaccard_join.Region([one]))) == []
    found = [(i, j) for i, near in jaccard_join.linked_pairs(jaccard_join.Region([one] * 30)) for j in near.tolist()]
    assert len(found) == 30 * 29 // 2 == len({tuple(sorted(p)) for p in found})


def test_removal_of_lines_is_linear_in_lines(spark):
    """A text four times as long, with all its lines but a third removed, costs some four times as much."""
    took = []
    tag = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    for n in (4_000, 16_000):
        own = lambda d, k: f"own{tag(k)} words{tag(k)} {'abcd'[d]}{tag(k)} line of page"
        texts = ["\n\n".join(own(d, k) if k % 3 == 0 else f"s{tag(k)} t{tag(k)} u{tag(k)}" for k in range(n)) for d in range(4)]
        d = spark.createDataFrame([(k, t, "h") for k, t in enumerate(texts)], "doc_id bigint, text string, source string").repartition(1)
        began = time.time()
        kept = {r["doc_id"]: r["text"] for r in quality.filter_documents(d, 2, 0.02, 10).collect()}
        took.append(time.time() - began)
        assert kept == {k: "\n".join(x for x in t.split("\n") if not x.startswith("s")) for k, t in enumerate(texts)}
    assert took[1] < 6 * took[0] + 5


def test_topk_of_repeated_rows(spark):
    """A third of all rows are one row, as candidates and as queries; some agree with it only as quantised or but for zeros at the end."""
    rng = np.random.default_rng(21)
    v = [(i, [float(x) for x in rng.integers(-50, 50, 4) / 256]) for i in range(400)]
    v += [(100, [0.25, 0.5])] * 200 + [(100, [0.25, 0.5, 0.0, 0.0]), (100, [0.2501, 0.5, 0.001]), (100, [0.25, 0.5, -0.001])]
    d = spark.createDataFrame(v, "vec_id bigint, embedding array<double>").repartition(7)
    whole = [(i, np.floor(256 * np.array([*e, *[0.0] * (4 - len(e))])).astype(int)) for i, e in v]
    want = []
    for i, e in whole:
        if i % 50 == 0:
            want += [(i, r + 1, k, -x) for r, (x, k) in enumerate(sorted((-int(x @ e), k) for k, x in whole if k != i)[:5])]
    found = [tuple(r) for r in topk.top_k(d).collect()]
    assert sorted(found) == sorted(want) and len(found) == 5 * (8 + 203)
