"""Repeated windows of words and periodic runs, against plain versions, with awkward rows."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ambiquant.llm import periodic_runs, supermers
from ambiquant.llm import queries as q

SCHEMA = "doc_id bigint, text string"


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def same(a, b):
    assert a == sorted(map(repr, b))


def passages(seed=5, n=160):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["é", "日本", "x" * 300, "a b"]
    base = [rnd.choice(words) for _ in range(400)]
    rows = []
    for i in range(n):
        a = rnd.randint(0, 350)
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 30))] + base[a : a + rnd.randint(0, 80)] + [rnd.choice(words) for _ in range(rnd.randint(0, 5))]
        rows.append((i * 3 % n, rnd.choice([" ", "\n", "  ", "\t\x0b", "\r\n"]).join(w)))
    rows += [(None, " ".join(base)), (None, None), (900, None), (901, ""), (902, " \n\t"), (903, "again " * 100), (904, "a b c d e " * 40), (905, " ".join(base)), (906, "  ".join(base))]
    rows += [(905, " ".join(base)), (905, "new " + " ".join(base[50:200])), (907, " ".join(base[:19])), (908, " ".join(base[:20])), (-4, " ".join(base[:20])), (2**62, " ".join(base[100:150]))]
    return rows


def test_supermers(spark):
    rows = passages()
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit("x"), "bucket": F.lit(1), "_h": F.lit(2), "number": F.lit(3)})
    same(got(supermers.digest(d)), brute.window_removals(rows))
    for window in (1, 3, 8):
        same(got(supermers.digest(d, window)), brute.window_removals(rows, window))


def test_supermers_of_nothing(spark):
    assert supermers.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None), (1, None), (2, "few words")]
    same(got(supermers.digest(spark.createDataFrame(rows, SCHEMA))), brute.window_removals(rows))


def test_hot_minimisers(spark):
    """A phrase in more documents than HOT, in unlike surroundings, and a whole passage in many."""
    rnd = random.Random(8)
    phrase, passage = [f"p{k}" for k in range(18)], [f"q{k}" for k in range(60)]
    word = lambda: f"v{rnd.randrange(500)}"
    rows = []
    for i in range(1400):
        middle = passage[rnd.randrange(5) :] if i % 5 == 0 else []
        rows.append((i, " ".join([*(word() for _ in range(15)), *phrase, *(word() for _ in range(15)), *middle, *(word() for _ in range(3))])))
    block = supermers.Block([r[0] for r in rows], [r[1] for r in rows], 20)
    assert block.keys()[1].max() >= supermers.HOT
    same(got(supermers.digest(spark.createDataFrame(rows, SCHEMA))), brute.window_removals(rows))


def test_hot_minimisers_do_not_share_a_bucket():
    rnd = random.Random(8)
    phrase = [f"p{k}" for k in range(18)]
    texts = [" ".join([*(f"v{rnd.random()}" for _ in range(20)), *phrase, *(f"v{rnd.random()}" for _ in range(20))]) for _ in range(900)]
    block = supermers.Block(list(range(900)), texts, 20)
    keys, n = block.keys()
    answer = {0: supermers._count(np.arange(len(keys)), n, keys).tobytes()}
    by, strings, _ = block.strings(answer, 50)
    sizes = [len(v) for v in by.values()]
    assert len(strings) >= 900 and len(by) == 50 and max(sizes) < 2 * sum(sizes) / 50 + supermers.HOT


def test_very_long_text(spark):
    rnd = random.Random(2)
    long = [f"w{rnd.randrange(40)}" for _ in range(70_000)]
    rows = [(7, " ".join(long)), (8, "y " + " ".join(long)), (9, "z " * 50_000), (3, " ".join(long[60_000:]))]
    same(got(supermers.digest(spark.createDataFrame(rows, SCHEMA))), brute.window_removals(rows))


def test_removed_windows_and_documents(spark):
    rows = passages()
    d = spark.createDataFrame([(i, t, "en", len(t or ""), "x") for i, t in rows], "doc_id bigint, text string, lang string, n_chars bigint, _words string")
    want = {(r[0], hashlib.sha256(" ".join(brute.WORD.findall(t or "")).encode()).hexdigest()): r for r, (_, t) in zip(brute.window_removals(rows), rows)}
    for r in supermers.remove_windows(d).collect():
        w = want[r["doc_id"], r["text_words"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == w[1:]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and hashlib.sha256(r["kept_text"].encode()).hexdigest() == w[3]
    out = supermers.dedup_documents(d)
    assert out.columns == d.columns and out.count() == len(rows)
    kept = sorted((repr(r["doc_id"]), " ".join(brute.WORD.findall(r["text"] or ""))) for r in out.collect())
    assert sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept) == sorted((repr(w[0]), w[3]) for w in brute.window_removals(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


def repetitive(rnd):
    kind, n, k = rnd.random(), rnd.randint(0, 90), rnd.choice([1, 2, 2, 3, 5])
    if kind < 0.3:
        return [rnd.randrange(k) for _ in range(n)]
    if kind < 0.5:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    d = []
    while len(d) < n:
        p = [rnd.randrange(k + 2) for _ in range(rnd.randint(1, 9))]
        d += (p * rnd.randint(1, 6))[: rnd.randint(1, 50)]
        if rnd.random() < 0.3:
            s = rnd.randint(0, len(d))
            d += d[s : s + rnd.randint(0, 60)]
    return d


def test_runs_of_random_sequences():
    rnd = random.Random(3)
    for _ in range(400):
        docs, least = [repetitive(rnd) for _ in range(rnd.randint(1, 6))], rnd.choice([2, 3, 5, 8, 12, 12, 20])
        ids = np.array([x for d in docs for x in d], np.int64)
        assert periodic_runs.runs_of(ids, [len(d) for d in docs], least) == [brute.periodic_runs(d, least) for d in docs]


def test_runs_with_long_ascents():
    """Suffixes that start ever later in the order, so that jumps alone would take many rounds."""
    n = 300
    down = [x for k in range(n, 0, -1) for x in (0, 1000 + k)]
    up = [x for k in range(1, n) for x in (0, 10 + k)]
    for d in (down + up, up + down, up + up, down * 3):
        assert periodic_runs.runs_of(np.array(d, np.int64), [len(d)]) == [brute.periodic_runs(d)]


@pytest.mark.parametrize("d", [[0] * 100_000, [k % 5000 for k in range(60_000)], [k % 7 for k in range(50_000)] + [9] * 50_000])
def test_runs_of_very_long_texts(d):
    got = periodic_runs.runs_of(np.array(d, np.int64), [len(d)])[0]
    want = {100_000: [(0, 100_000, 1)], 60_000: [(0, 60_000, 5000)]}.get(len(d) if len(set(d)) != 8 else 0, [(0, 50_000, 7), (50_000, 50_000, 1)])
    assert got == want


def run_rows(rows, tails):
    out = []
    for i, t in rows:
        w = brute.WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        if tails and i is not None and w and h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs, keep = brute.periodic_runs(w), [True] * len(w)
        for s, n, p in runs:
            keep[s + p : s + n] = [False] * (n - p)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        out.append((i, len(w), len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest()))
    return out


def test_runs_of_documents(spark, tmp_path):
    rnd = random.Random(11)
    rows = passages() + [(i, " ".join(map(str, repetitive(rnd)))) for i in range(2000, 2200)] + [(i, "1 2 3 " * 9) for i in (5000, 5001, 5001)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "a": F.lit(1), "start": F.lit(2), "w": F.lit(3)})
    same(got(periodic_runs.digest(d)), run_rows(rows, False))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    same(got(q.op11_periodic_runs(spark, str(tmp_path))), run_rows(rows, True))
    assert periodic_runs.digest(d.limit(0)).collect() == []


def test_collapsed_documents(spark):
    rows = passages()
    d = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    out = periodic_runs.collapse_documents(d)
    want = sorted((repr(r[0]), r[-1]) for r in run_rows(rows, False))
    assert out.columns == d.columns
    assert sorted((repr(r["doc_id"]), hashlib.sha256(" ".join(brute.WORD.findall(r["text"] or "")).encode()).hexdigest()) for r in out.collect()) == want
    found = {(r["doc_id"], r["n_runs"]): r for r in periodic_runs.find_runs(d).collect()}
    assert found[904, 1]["collapsed_text"] == "a b c d e" and [tuple(x) for x in found[904, 1]["runs"]] == [(0, 200, 5)]
