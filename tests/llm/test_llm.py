"""Operators against plain versions, SQL and exact round trips, with awkward rows."""

import hashlib
import os
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ambiquant.llm import bpe, chat, jaccard_join, licenses, mixing, quality, suffix_dedup, token_counts, topk, toxicity
from ambiquant.llm import queries as q

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def documents(texts, sources=("a", "b", None)):
    return [(i, t, "en", sources[k % len(sources)], len(t or "")) for k, (i, t) in enumerate(texts)]


def awkward():
    rnd = random.Random(7)
    base = "".join(rnd.choice("ab ") for _ in range(1500))
    rows = []
    for i in range(120):
        a = rnd.randint(0, 1400)
        rows.append((i, "".join(rnd.choice("abcdé\n ") for _ in range(rnd.randint(0, 80))) + base[a : a + rnd.randint(0, 260)] + "#" * (i % 3)))
    vocabulary = [f"w{k}" for k in range(30)]
    for i in range(120, 240):
        w = [vocabulary[(i // 12 * 7 + k * k) % 30] for k in range(40)]
        if i % 3:
            w[rnd.randrange(40)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(None, base), (None, None), (300, None), (301, ""), (302, "\n \t"), (303, "x " * 4000), (304, "one two"), (305, "One  two"), (306, base * 4)]
    return rows + [rows[5], rows[130], (5, rows[6][1])]


@pytest.fixture(scope="module")
def frame(spark):
    d = spark.createDataFrame(documents(awkward()), DOC)
    return d.withColumns({"block": F.lit("x"), "key": F.lit(1), "_h": F.lit(2), "size": F.lit(3), "kept": F.lit("no")})


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def same(a, b):
    assert a == sorted(map(repr, b))


def test_suffix_dedup(frame):
    same(got(suffix_dedup.digest(frame)), brute.removal_digest(awkward()))


def test_suffix_dedup_with_hot_anchors(spark):
    """A passage in more than HOT documents, with parts of it in others and long runs."""
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    rows = []
    for i in range(400):
        a = rnd.choice([0, 0, 0, rnd.randint(0, 200)])
        middle = passage[a:] if i % 7 else passage[a : a + 120] + "X" + passage[a + 121 :]
        rows.append((i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 40))) + middle + "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 40)))))
    whole = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    rows += [(500, whole), (501, "y" + whole), (502, whole[:5000] + "z" + whole[5000:])]
    same(got(suffix_dedup.digest(spark.createDataFrame(rows, "doc_id bigint, text string"))), brute.removal_digest(rows))


def test_hot_copies(spark):
    """More copies than a block takes; some are near copies."""
    text = " ".join(f"w{k * k % 97}" for k in range(60))
    rows = [(i, text if i % 5 else text + f" end{i}") for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(got(suffix_dedup.digest(d)), brute.removal_digest(rows))
    same(got(jaccard_join.components(d)), brute.components(rows))


def test_suffix_order_and_merge():
    rnd = random.Random(1)
    strings = [[bytes(rnd.choice(b"ab") for _ in range(rnd.randint(50, 90))) for _ in range(5)] for _ in range(4)]
    text = np.frombuffer(b"\xff".join([*strings[0], b""]), np.uint8) + np.uint8(1)
    order = suffix_dedup.suffix_order(text)
    end = np.cumsum([len(s) + 1 for s in strings[0]])
    key = lambda p: (text[p : end[np.searchsorted(end, p, side="right")]].tobytes(), p)
    assert order.tolist() == sorted(range(len(text)), key=key)
    owners = [np.arange(5) * 4 + k for k in range(4)]
    bits = suffix_dedup.repeated([(suffix_dedup.transform(s), o) for s, o in zip(strings, owners)])
    least = {}
    for s, o in zip(strings, owners):
        for t, d in zip(s, o):
            for p in range(len(t) - 49):
                least[t[p : p + 50]] = min(d, least.get(t[p : p + 50], d))
    for s, o, b in zip(strings, owners, bits):
        want = [p + 50 <= len(t) and bool(least[t[p : p + 50]] < d) for t, d in zip(s, o) for p in range(len(t) + 1)]
        assert b.tolist() == want


def test_keys_as_steps():
    from ambiquant.llm import blocks

    rng = np.random.default_rng(8)
    for size, top in ((0, 60), (1, 64), (5, 64), (3000, 62), (3000, 50)):
        keys = np.unique(blocks.short_keys(rng.integers(0, 1 << top, size, dtype=np.uint64) if top < 64 else rng.integers(0, (1 << 64) - 1, size, dtype=np.uint64)))
        assert (blocks._long(blocks._short(keys)) == keys).all()


def test_sizes_of_blocks():
    from ambiquant.llm import blocks

    assert blocks.plan_of(0, 4) == (4, 8) and blocks.plan_of(1 << 30, 4) == (256, 256)
    n, b = blocks.plan_of(10**14, 10_000)
    assert 10**14 / n < 400e6 and 10**14 / n / b >= 900


def test_rows_of_one_doc_id(spark):
    """Rows of one doc_id lose what their own text loses; columns may have any name."""
    rows = [(1, "x" * 60, 0), (2, "x" * 60 + "y", 1), (2, "z" * 60, 2), (2, "x" * 60 + "y", 3), (3, "own", 4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, _id int").withColumns({"kept_text": F.lit("k"), "_md5": F.lit(7), "_KEPT": F.lit(8)})
    cut = suffix_dedup.dedup_documents(d)
    assert cut.columns == d.columns
    same(got(cut.select("doc_id", "text", "_id")), [(1, "x" * 60, 0), (2, "y", 1), (2, "z" * 60, 2), (2, "y", 3), (3, "own", 4)])
    kept = jaccard_join.one_of_each(spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2)], "doc_id bigint, text string, _id int"))
    same(got(kept), [(1, "a b c d e f", 1)])


def test_dedup_documents(spark):
    text = "é" * 30 + "abcdefghij" * 6
    d = spark.createDataFrame(documents([(1, "x" * 9 + text), (2, "zz" + text + "é"), (3, "own")]), DOC)
    rows = {r["doc_id"]: r for r in suffix_dedup.dedup_documents(d).collect()}
    assert rows[2]["text"] == "zzé" and rows[2]["n_chars"] == 3 and rows[1]["text"] == "x" * 9 + text
    assert suffix_dedup.dedup_documents(d).columns == d.columns


def test_jaccard_components(frame):
    same(got(jaccard_join.components(frame)), brute.components(awkward()))


def test_large_regions_are_split(spark, monkeypatch):
    """Cells, border sets, recursion and tiles, with copies, chains of near copies and a doc_id in two classes."""
    monkeypatch.setattr(jaccard_join, "ROWS", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    rnd = random.Random(21)
    rows = []
    for group in range(4):
        words = [f"g{group}w{k}" for k in range(80)] + [f"all{k}" for k in range(20)]
        for i in range(60):
            if group < 2:  # a ball
                own = list(words)
                for k in rnd.sample(range(100), rnd.randint(0, 3)):
                    own[k] = f"x{group}{i}{k}"
            else:  # a chain: the text slides along a longer one
                own = [f"g{group}w{k}" for k in range(2 * i, 2 * i + 60)] + words[-20:]
            rows.append((1000 * group + i, " ".join(own)))
    rows += [(rows[k][0] + 500, rows[k][1].upper()) for k in range(0, 240, 7)] + [(3, rows[130][1]), rows[40], (None, rows[2][1])]
    rnd.shuffle(rows)
    split = []
    real = jaccard_join._divided
    monkeypatch.setattr(jaccard_join, "_divided", lambda *a: split.append(1) or real(*a))
    same(got(jaccard_join.components(spark.createDataFrame(rows, "doc_id bigint, text string"))), brute.components(rows))
    assert split


def test_labels(spark):
    """A chain of 200 nodes, a star and a ring."""
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(2000 + k, 2000 + (k + 1) % 30) for k in range(30)] + [(5000, 5000)]
    random.Random(2).shuffle(links)
    found = {r["node"]: r["label"] for r in jaccard_join.labels(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {n: n // 1000 * 1000 for n in [*range(1, 201), *range(1001, 1050), *range(2001, 2030)]}


def test_one_of_each_and_empty(spark, frame):
    kept = jaccard_join.one_of_each(frame)
    want = {i for i, _, c, _ in brute.components(awkward()) if i is None or c == i}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == frame.columns
    empty = frame.limit(0)
    for df in (jaccard_join.components(empty), suffix_dedup.digest(empty), bpe.digest(empty), quality.measure(empty), mixing.mix(empty), licenses.scan(empty)):
        assert df.count() == 0


def test_region_equals_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.choice(1000, 40, replace=False)
        sets = [np.unique(np.where(rng.random(40) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 1000, 40), base)).astype(np.uint64) for _ in range(40)]
        root, links = list(range(40)), [0] * 40

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(40):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        roots, counts = jaccard_join.join_region(sets, [0] * 40, [[]] * 40, [1] * 40)
        assert roots == [find(i) for i in range(40)] and counts == links


@pytest.fixture(scope="module")
def reference_tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocabulary())


def odd_texts():
    rnd = random.Random(3)
    signs = [*"abc  'stre\n\t\r\x1c\x1f\x85\u00a0\u3000éßñ漢字😀123٣½²!?.<|>_-", "<|endoftext|>", "'re", " \n", "\u200b"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(800)] + ["", "a" * 5000, " " * 3000, "the " * 3000]


def test_bpe(spark, reference_tokenizer):
    texts = odd_texts()
    d = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    rows = {r["doc_id"]: r for r in bpe.digest(d).collect()}
    for i, t in [*enumerate(texts), (None, "")]:
        ids = reference_tokenizer.encode(t, add_special_tokens=False).ids
        back = reference_tokenizer.decode(ids, skip_special_tokens=False)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    again = bpe.decode(bpe.encode(d))
    assert again.filter(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0


def test_token_counts(spark, reference_tokenizer):
    rnd = random.Random(5)
    texts = [t.replace("<|endoftext|>", "") for t in odd_texts()]
    rows = []
    for i, t in enumerate(texts):
        edits = [(rnd.randint(-1, len(t) + 2), rnd.randint(0, 6), rnd.choice(["", "x", " 'r", "\n "])) for _ in range(3)]
        rows.append((i, t, edits))
    rows.append((None, None, None))
    got_ = {r["doc_id"]: r for r in token_counts.count_with_edits(spark.createDataFrame(rows, f"doc_id bigint, text string, edits {token_counts.EDITS}")).collect()}
    reference_tokenizer.encode_special_tokens = True
    for i, t, edits in rows:
        t = t or ""
        assert got_[i]["n_tokens"] == len(reference_tokenizer.encode(t, add_special_tokens=False).ids)
        for at, n, new in edits or []:
            at = min(max(at, 0), len(t))
            t = t[:at] + new + t[at + n :]
        assert got_[i]["n_chars_after"] == len(t)
        assert got_[i]["n_tokens_after"] == len(reference_tokenizer.encode(t, add_special_tokens=False).ids)
    reference_tokenizer.encode_special_tokens = False


def test_edits_recount_little():
    """An edit encodes what is near it and updates nodes on its path, also when it inserts."""
    codec = bpe.Codec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    text = "some words here " * 40_000
    tree = token_counts.SegmentTree(codec, text)
    blocks = tree.root.blocks
    assert blocks > 900
    rnd = random.Random(4)
    for k in range(300):
        tree.recounted = tree.touched = 0
        at, n, new = rnd.randrange(len(text)), rnd.randint(0, 5), rnd.choice(["", "new", " a few more words", "x"])
        tree.edit(at, n, new)
        text = text[:at] + new + text[at + n :]
        assert tree.recounted < 20 and tree.touched < 12 * np.log2(blocks)
    assert tree.text() == text and tree.n_tokens == len(codec.encode(text))
    whole = token_counts.SegmentTree(codec, text)
    assert tree.leaves() == whole.leaves()


def test_stored_trees(spark, reference_tokenizer):
    """Edits in two batches, the second on what the first has stored; nulls, no rows, other columns."""
    rnd = random.Random(15)
    rows = [(i, t.replace("<|endoftext|>", "")) for i, t in enumerate(odd_texts()[:150])] + [(None, None), (5, "a row of a known id"), (9000, "it's 12 o'clock " * 700)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_touched", F.lit("clash"))
    trees = token_counts.build_trees(d)
    n = F.length("text")
    edit = lambda at, k, new: F.struct(at.cast("bigint").alias("start"), F.lit(k).cast("bigint").alias("length"), F.lit(new).alias("text"))
    once = token_counts.apply_edits(trees.withColumn("edits", F.array(edit(n / 2, 3, " 'r"), edit(n, 0, "e")))).drop("n_recounted")
    twice = token_counts.apply_edits(once.withColumn("edits", F.array(edit(n / 3, 0, "x\n "), F.lit(None)))).withColumn("edits", F.lit(None))
    reference_tokenizer.encode_special_tokens = True
    for step in (trees, once, twice):
        for r in step.collect():
            assert r["n_tokens"] == len(reference_tokenizer.encode(r["text"], add_special_tokens=False).ids) == sum(r["leaf_counts"])
    reference_tokenizer.encode_special_tokens = False
    long = [r for r in twice.collect() if r["doc_id"] == 9000]
    assert long[0]["n_recounted"] < 20 and len(long[0]["leaf_sizes"]) > 2500
    assert token_counts.apply_edits(twice.limit(0)).count() == 0 == token_counts.count_with_edits(d.limit(0).withColumn("edits", F.array())).count()


def test_filter_documents_with_any_columns(spark):
    rows = [(k, " ".join("ab"[k >> i & 1] * 3 + chr(97 + i) for i in range(20)) + "\nthe same line", "s") for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(c) for c in ("_id", "_row", "_row2", "_removed", "_gone", "_hashes", "removed")})
    kept = quality.filter_documents(d)
    assert kept.columns == d.columns and kept.count() == 60 and kept.filter("text like '%same%' or _row <> '_row' or removed <> 'removed'").count() == 0
    assert quality.filter_documents(d.limit(0)).count() == 0 == suffix_dedup.dedup_documents(d.limit(0)).count() == jaccard_join.one_of_each(d.limit(0)).count()


def test_quality(frame):
    rows = [(i, t, s) for i, t, _, s, _ in documents(awkward())]
    want = [(i, k) for i, k, _ in brute.quality(rows, 5, 0.03)]
    same(got(quality.measure(frame, 5, 0.03).select("doc_id", "kept")), want)
    kept = quality.filter_documents(frame, 5, 0.03)
    assert kept.columns == frame.columns
    same(got(kept.select("doc_id", "text")), [(i, t) for i, k, t in brute.quality(rows, 5, 0.03) if k])


def lines_removed(rows, least_docs, max_share):
    """n_lines_removed of each row (doc_id, text, source), by a plain count of the distinct texts that hold a line."""
    lines = lambda t: [brute.line_hash(x) for x in (t or "").split("\n") if brute.WORD.search(x)]
    holders, every = {}, {}
    for _, t, s in rows:
        every.setdefault(s, set()).add(t or "")
        for x in lines(t):
            holders.setdefault((s, x), set()).add(t or "")
    hot = {k for k, ts in holders.items() if len(ts) > max(least_docs, max_share * len(every[k[0]]))}
    return len(hot), [(i, sum((s, x) in hot for x in lines(t))) for i, t, s in rows]


def test_quality_counts_documents_with_several_shared_lines(spark):
    block = [f"footer {c} of this site" for c in "abcdef"]
    own = lambda k: " ".join(f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    texts = [own(k) for k in range(200)]
    texts += ["\n".join([own(k), *block]) for k in range(200, 240)]
    texts += [f"only digits differ here, so it is document {k} of the same words as others" for k in range(100, 130)]
    texts += ["\n".join([own(300), "a line of a page with many copies"])] * 60
    docs = spark.createDataFrame([(k, t, "en", "h", len(t)) for k, t in enumerate(texts)], DOC)
    n_hot, want = lines_removed([(k, t, "h") for k, t in enumerate(texts)], 20, 0.02)
    assert n_hot == 7
    m = quality.measure(docs)
    same(got(m.select("doc_id", "n_lines_removed")), want)
    kept = {r["doc_id"] for r in m.filter("kept").collect()}
    assert not kept & set(range(240, 270)) and kept >= set(range(270, 330))
    rows = documents(awkward(), ("a",))
    m = quality.measure(spark.createDataFrame(rows, DOC), 5, 0.01)
    same(got(m.select("doc_id", "n_lines_removed")), lines_removed([(i, t, s) for i, t, _, s, _ in rows], 5, 0.01)[1])


def test_mixing(frame):
    rows = [(i, t, s) for i, t, _, s, _ in documents(awkward())]
    size, taken = brute.mix(rows)
    m = mixing.mix(frame, bins=16)
    same(got(m.select("doc_id", "size", "taken")), [(i, n, t) for (i, _, _), n, t in zip(rows, size, taken)])
    for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 1


def test_mix_documents(spark):
    """Columns of any name, rows of one doc_id, given weights and an empty table."""
    rows = [(k, f"w{k} and more words", "ab"[k % 2], 1.0, k) for k in range(60)]
    rows += [rows[7], (8, "another text of a known id", "b", None, 99), (None, "no id", None, 1.0, 100), (61, "", "a", 1.0, 101), (62, None, "a", 1.0, 102)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, w double, _id int").withColumns({"_copy": F.lit("c"), "_copies": F.lit(5), "_hash": F.lit(1), "size": F.lit(2), "part": F.lit(3)})
    out = mixing.mix_documents(d)
    assert out.columns == d.columns and out.filter("_copy <> 'c' or _copies <> 5 or size <> 2").count() == 0
    taken = {(r["doc_id"], r["text_hash"]): r["epochs"] + (2 * r["part"] >= r["size"]) for r in mixing.mix(d).filter("size > 0").collect()}
    back = {(r["doc_id"], r["h"]): r["count"] for r in out.groupBy("doc_id", F.xxhash64("text").alias("h")).count().collect()}
    twice = [k for k in taken if k[0] == 7]
    assert {k: n for k, n in taken.items() if n and k not in twice} == {k: n for k, n in back.items() if k not in twice} and all(back.get(k, 0) % 2 == 0 for k in twice)
    heavy = mixing.mix(d.withColumn("w", F.when(F.col("doc_id") % 4 == 0, 1e6).otherwise(F.col("w"))), weights=(1, 9), quality="w")
    assert heavy.filter("source = 'a' and doc_id % 4 = 2 and taken > 0").count() == 0 < heavy.filter("source = 'a' and doc_id % 4 = 0 and taken > 0").count()
    assert mixing.mix_documents(d.limit(0)).count() == 0


@here
@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({q.oracle_sql()[name]})").fetchall()
    same(got(df.select(cols)), [tuple(r) for r in want])


def test_chat_parts_and_escapes(spark):
    part = lambda kind, text=None, ref=None, n=None: (kind, text, ref, n)
    rows = [
        (1, 0, "user", [part("text", "see </turn> \\l <image:1>"), part("image", ref="a.png", n=85), part("text", "and"), part("audio", ref="b.wav", n=20)]),
        (1, 1, "assistant", [part("text", "\\b<turn:user>\n"), part("document", ref="c.pdf")]),
        (2, None, "a>b\nc", None), (2, None, "assistant", [part("text", None)]), (None, 3, None, [part("text", "x")]),
    ]
    d = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, ps {chat.PART_TYPE}").withColumn("formatted", F.lit("clash"))
    f = chat.format_conversations(d, parts="ps")
    r = {x["conv_id"]: x for x in chat.parse_formatted(f).collect()}
    assert [a["ordinal"] for a in r[1]["attachments"]] == [1, 2, 3] and r[1]["attachments"][0]["ref"] == "a.png"
    assert r[1]["expanded_tokens"] == 85 + 20 + 6 + 1 + 4
    assert r[1]["turns"][0]["text"] == "see </turn> \\l <image:1><image:1>and<audio:2>"
    assert [t["role"] for t in r[2]["turns"]] == ["a>b\nc", "assistant"] and r[None]["turns"][0]["role"] == ""
    g = chat.digest(chat.format_conversations(spark.createDataFrame([(7, 0, "user", "q"), (7, 1, "assistant", "\\<l\\b"), (7, 1, "assistant", "z")], "conv_id bigint, turn bigint, role string, text string"))).first()
    assert g["loss_chars"] == 6 and g["loss_sha256"] == hashlib.sha256(b"\\<l\\bz").hexdigest() and g["n_turns"] == 3
    assert g["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\n\\<l\\b\nassistant\nz\n").hexdigest()


def test_chat_unknown_kinds_long_conversations_and_empty(spark):
    part = lambda kind, text=None, ref=None, n=None: (kind, text, ref, n)
    rows = [(1, 0, "user", [part("video", "a note", "a.mp4", 9), part(None, "text"), part("image", ref="b", n=1)]), (1, 1, "user", []), (1, 2, "assistant", [part("<x:", ref="c", n=2), part("text", "end")])]
    f = chat.format_conversations(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, ps {chat.PART_TYPE}").withColumn("rn", F.lit(0)), parts="ps")
    r = chat.parse_formatted(f).first()
    assert [t["text"] for t in r["turns"]] == ["<attachment:1>text<image:2>", "", "<attachment:3>end"] and r["expanded_tokens"] == 9 + 1 + 1 + 2 + 1
    assert [(a["kind"], a["ordinal"], a["ref"]) for a in r["attachments"]] == [("video", 1, "a.mp4"), ("image", 2, "b"), ("<x:", 3, "c")]
    text = lambda k: "<" * (k % 3) + f"turn {k}"
    long = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", text(k)) for k in range(30_000)] + [(2, 0, "user", "x" * 2_000_000 + "<"), (2, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    got_ = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(long)).collect()}
    said = "".join(text(k) for k in range(30_000) if k % 2)
    assert got_[1]["n_turns"] == 30_000 and got_[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got_[2]["turns_sha256"] == hashlib.sha256(("user\n" + "x" * 2_000_000 + "<\nassistant\n\n").encode()).hexdigest() and got_[2]["loss_chars"] == 0
    assert chat.digest(chat.format_conversations(long.limit(0))).count() == 0


def containments(texts, templates):
    """(doc_id, license) -> best containment and matching windows, over all windows, by plain sets."""
    found = {}
    for name, template in templates.items():
        w = re.findall("[a-z0-9]+", template.lower())
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        span = max(8, 1 << (len(w) - 1).bit_length())
        for i, t in texts:
            x = re.findall("[a-z0-9]+", (t or "").lower())
            grams = [tuple(x[k : k + 5]) for k in range(len(x) - 4)]
            shares = [len(want & set(grams[j : j + 2 * span])) / len(want) for j in range(0, max(1, len(grams)), span)]
            good = [c for c in shares if c >= 0.75]
            if good:
                found[i, name] = (max(good), len(good))
    return found


def test_licenses(spark):
    """Every notice and text, whole, cut, with words changed, near borders of windows; a template of 3000 words."""
    rnd = random.Random(31)
    every = licenses.TEMPLATES | licenses.FULL_TEXTS | {"long": " ".join(f"t{rnd.randrange(900)}" for _ in range(3000))}
    filler = lambda n: " ".join(rnd.choice(["word", "other", "license", "the", "software", "is"]) + str(rnd.randrange(50)) for _ in range(n))
    texts = []
    for t in every.values():
        for change in (0.0, 0.02, 0.08):
            w = [x if rnd.random() >= change else "changed" for x in t.split()]
            cut = w[: rnd.randint(len(w) // 2, len(w))] if change else w
            texts.append((len(texts), f"{filler(rnd.randint(0, 60))}\n{' '.join(cut).upper() if change else ' '.join(cut)}.\n{filler(rnd.randint(0, 300))}"))
    texts += [(9000, filler(20_000)), (9001, None), (9002, ""), (9004, "released under the BSD license"), (9005, " ".join(licenses.TEMPLATES["mit"] for _ in range(500))), texts[0], (9006, licenses.TEMPLATES["mit"])]
    want = containments(texts, every)
    assert len({n for _, n in want}) == len(every) and len(want) > 30
    d = spark.createDataFrame([*texts, (None, "RELEASED under the, MIT license!")], "doc_id bigint, text string").withColumns({"license": F.lit(1), "_grams": F.lit(2)})
    rows = licenses.scan(d, every, recall=1 - 1e-9).collect()
    found = {(r["doc_id"], r["license"]): (r["containment"], r["n_windows"]) for r in rows if r["doc_id"] is not None}
    assert found == want and len(rows) == len(want) + 1 + sum(i == texts[0][0] for i, _ in want)
    usual = {(r["doc_id"], r["license"]) for r in licenses.scan(d, every).collect()} - {(None, "mit"), (None, "mit-grant")}
    assert usual <= set(want) and len(usual) >= len(want) - 1
    with pytest.raises(ValueError):
        licenses.scan(d, {"short": "MIT license"})
    assert licenses.scan(d, {}).count() == 0


def test_licenses_are_missed_no_more_often_than_stated(spark):
    """Exact notices of one shingle that lie in one window only, each in another random context."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"x{k}" for k in rng.integers(0, 1 << 40, n)]
    texts = [(k, " ".join([*word(3), licenses.TEMPLATES["mit"], *word(40)])) for k in range(4000)]
    found = licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), {"mit": licenses.TEMPLATES["mit"]})
    assert 4000 - found.count() <= 14  # 4 are expected at a recall of 0.999


def test_topk(spark):
    """Nulls, repeated candidates and queries, ties, other lengths, clashing names."""
    rng = np.random.default_rng(6)
    v = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    v += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 6), (550, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (350, v[0][1]), (600, v[3][1]), (601, v[3][1]), (0, v[9][1]), (50, v[50][1]), (650, [0.0] * 6), (651, [0.5] * 4), (700, [])]
    d = spark.createDataFrame(v, "vec_id bigint, embedding array<float>").withColumns({"q": F.lit(1), "part": F.lit(2), "v": F.lit(3)})
    fit = lambda e: np.floor(256 * np.array([*e, *[0] * (6 - len(e))], np.float32).astype(float)).astype(int)
    good = [(i, fit(e)) for i, e in v if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for i, e in good:
        if i % 50 == 0:
            s = sorted((-int(x @ e), k) for k, x in good if k != i)[:5]
            want += [(i, r + 1, k, -x) for r, (x, k) in enumerate(s)]
    same(got(topk.top_k(d)), want)
    assert topk.top_k(d.limit(0)).count() == 0


def test_topk_parts_and_large_components(spark, monkeypatch):
    """Several parts, of unlike norms, and components whose products need Python's integers on the way."""
    rng = np.random.default_rng(16)
    for scale, n in ((300, 9000), (1 << 40, 200)):
        size = rng.pareto(1.0, (n, 1)) + 0.1
        vectors = np.clip(rng.normal(0, 1, (n, 12)) * size * scale, -(1 << 62), 1 << 62).astype(np.int64)
        if scale > 300:
            vectors[:, 1:] = 0
            vectors[:, 0] %= 1 << 31
            vectors[3, 5] = 1 << 62
        ids = rng.permutation(n) // 2
        own, queries = ids[:70], vectors[:70]
        found = topk.search_block(ids, vectors, own, queries, 5)
        for i, e, (a, s) in zip(own, queries, found):
            scores = vectors.astype(object) @ e.astype(object)
            want = sorted((-x, int(k)) for x, k in zip(scores, ids) if k != i)[:5]
            assert [(-x, k) for x, k in zip(s, a)] == want
    d = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1e7, 0.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    same(got(topk.top_k(d)), [(0, 1, 1, 2560000000**2), (0, 2, 2, 2560000000 * 256 + 256 * 256)])
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id bigint, embedding array<double>")).collect()


def test_convolution_and_gradient():
    """Logits by plain loops; a first step against the numeric gradient of the loss."""
    m = toxicity.Model(slots=50, dim=4, filters=3, seed=2)
    rng = np.random.default_rng(3)
    m.embedding[:50] = rng.normal(0, 0.7, (50, 4))
    texts = [rng.integers(0, 50, n).tolist() for n in (0, 1, 2, 7, 30, 12)]
    y = np.array([0, 1, 0, 1, 1, 0])

    def plain(embedding, kernels, offsets, out):
        logits = []
        for t in texts:
            e = [embedding[i] for i in (*t, 50, 50, 50)]
            top = []
            for kernel, offset in zip(kernels, offsets):
                w = len(kernel)
                values = [sum(e[i + k] @ kernel[k] for k in range(w)) + offset for i in range(len(e) - w + 1)]
                top += np.maximum(np.max(values, axis=0), 0).tolist()
            logits.append(np.dot(top, out) + float(m.bias))
        return np.array(logits)

    wide = lambda: (m.embedding.astype(float), [k.astype(float) for k in m.kernels], [o.astype(float) for o in m.offsets], m.out.astype(float))
    parts = wide()
    assert np.allclose(m.logits(texts), plain(*parts), atol=1e-4)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)

    def loss():
        p = 1 / (1 + np.exp(-plain(*parts)))
        return -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum() / len(y)

    def numeric(array, at, step=1e-5):
        old = array[at]
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        return (up - down) / (2 * step)

    probes = [(parts[3], (k,)) for k in range(9)] + [(parts[1][2], (k, d, f)) for k in range(3) for d in (0, 3) for f in range(3)] + [(parts[0], (texts[3][k], d)) for k in range(7) for d in range(4)]
    g = np.array([numeric(a, at) for a, at in probes])
    before = wide()
    m.fit(texts, y, epochs=1, rate=0.05, batch=6)
    after = wide()
    pairs = [(3, (k,)) for k in range(9)] + [((1, 2), (k, d, f)) for k in range(3) for d in (0, 3) for f in range(3)] + [(0, (texts[3][k], d)) for k in range(7) for d in range(4)]
    pick = lambda tree, where: tree[where] if isinstance(where, int) else tree[where[0]][where[1]]
    moved = np.array([pick(after, w)[at] - pick(before, w)[at] for w, at in pairs])
    assert np.abs(g).max() > 1e-2 and np.allclose(moved, -0.05 * g / np.sqrt(1e-3 + g * g), atol=2e-3)


def test_toxicity_of_odd_rows(spark):
    """Empty and very long texts, repeated rows and labels, clashing columns, empty tables."""
    rows = [(k, ("vile scum " if k % 2 else "kind words ") + f"w{k}", "en") for k in range(200)] + [(3, "another text of a known id", None), (7, None, "de")]
    rows += [(1000, "vile scum " * 200_000, "en"), (1001, None, None), (1001, None, None), (1002, "", "fr")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit(9) for c in ("_id", "_y", "_held", "_d", "ids", "score", "toxic")})
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(5, 1), (None, 1), (6, None), (1000, 1)], "doc_id bigint, toxic int").withColumn("_id", F.lit(4))
    model, cuts = toxicity.train(d, labels)
    out = toxicity.score(d, model, cuts)
    got_ = out.collect()
    assert len(got_) == len(rows) and all(0 <= r["score"] <= 1 for r in got_)
    assert len({r["score"] for r in got_ if r["doc_id"] == 1001}) == 1 and [r["predicted"] for r in got_ if r["doc_id"] == 1000] == [1]
    assert toxicity.score(d.limit(0), model, cuts).count() == 0
    assert toxicity.train(d.limit(0), labels)[0].constant == 0.0


def test_fit_of_long_texts_in_pieces_and_best_cut(monkeypatch):
    """Texts in pieces fit like whole ones; parameters survive being made rows; the cut against all cuts."""
    rng = np.random.default_rng(4)
    texts, y = [rng.integers(0, 60, n) for n in (0, 1, 4, 5, 6, 40, 33, 12)], np.array([0, 1, 0, 1, 1, 0, 1, 0])
    tables = []
    for at_once in (1000, 5, 1):
        monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", at_once)
        m = toxicity.Model(slots=60, filters=3, seed=2)
        m.embedding[:60] = np.random.default_rng(3).normal(0, 0.7, (60, 8))
        m.fit(texts, y, epochs=3, batch=4)
        tables.append(m.table())
        again = toxicity.Model(slots=60, filters=3, seed=8)
        again.set_table(m.table())
        assert np.array_equal(again.table(), m.table()) and np.array_equal(again.logits(texts), m.logits(texts))
        assert np.allclose(m.logits_of_all(texts), m.logits(texts))
    assert np.allclose(tables[0], tables[1], atol=1e-4) and np.allclose(tables[0], tables[2], atol=1e-4)
    for text in ("", " \n", "One two, ΟΔΟΣ! one"):
        assert toxicity.unpacked_words(toxicity.packed_words(text, 1 << 19)).tolist() == toxicity.word_ids(text, 1 << 19)
    for _ in range(50):
        at, zeros, ones = rng.permutation(40)[:12] - 20, rng.integers(0, 3, 12), rng.integers(0, 3, 12)
        zeros[0] = ones[1] = 1
        balance = lambda c: zeros[at < c].sum() / zeros.sum() + ones[at >= c].sum() / ones.sum()
        assert abs(balance(toxicity.best_cut(at, zeros, ones) * toxicity.STEPS) - max(map(balance, range(-21, 22)))) < 1e-9


def test_toxicity_is_fitted_on_every_labelled_document(spark, monkeypatch):
    """Words that only documents far down the order of hashes have, or only long ones; several groups, other partitions."""
    monkeypatch.setattr(toxicity, "GROUP_BYTES", 1, raising=False)
    ids = [r[0] for r in spark.range(9000).filter(toxicity.remainder(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id").collect()]
    rows = []
    for i, k in enumerate(ids):
        word = "kind" if i % 2 == 0 else "grobian" if i >= 6000 else "knave" if i % 50 == 1 else "scum"
        rows.append((k, " ".join(["some"] * (4200 if word == "knave" or i % 150 == 0 else 1) + [word, f"w{i % 40}", "words"]), "en"))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, i % 2) for i, k in enumerate(ids)], "doc_id bigint, toxic int")
    model, cuts = toxicity.train(d, labels)
    said = ["some grobian w3 words", "some knave w4 words", "some scum w5 words", "some kind w6 words"]
    odd = spark.createDataFrame([(-k, t, "en") for k, t in enumerate(said)], "doc_id bigint, text string, lang string")
    assert [r["predicted"] for r in toxicity.score(odd, model, cuts).orderBy(F.desc("doc_id")).collect()] == [1, 1, 1, 0]
    rows_, groups = toxicity.labelled(d, labels)
    assert groups > 2 and rows_.count() == len(ids) and rows_.select("_g").distinct().count() == groups
    other, other_cuts = toxicity.train(d.repartition(7), labels)
    assert np.array_equal(other.table(), model.table()) and (other.shift, other_cuts) == (model.shift, cuts)


@here
def test_toxicity(spark):
    rows = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").limit(0))
    assert rows[0].constant == 0.0
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model, cuts = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "idiot scum", "en")], "doc_id bigint, text string, lang string")
    s = toxicity.score(docs.select("doc_id", "text", "lang").unionByName(odd), model, cuts)
    assert s.filter("doc_id is null or doc_id < 0").filter("score between 0 and 1").count() == 3
    j = s.drop("toxic").join(labels.filter("toxic is not null"), "doc_id").filter("held_out")
    share = j.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert share > 0.93


@here
def test_pipeline(spark, reference_tokenizer):
    import corpus_pipeline

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = [(i, t, s) for (i, _, s), (_, ok, t) in zip(rows, brute.quality(rows)) if ok]
    keep = {i for i, _, c, _ in brute.components([(i, t) for i, t, _ in rows]) if i == c}
    rows = [r for r in rows if r[0] in keep]
    rows = [(i, np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore"), s) for (i, b, m), (_, _, s) in zip(brute.removal_masks([r[:2] for r in rows]), rows)]
    size, taken = brute.mix(rows)
    want = []
    for (i, t, _), n, k in zip(rows, size, taken):
        copies = k // n + (1 if 2 * (k % n) >= n else 0) if n else 0
        ids = reference_tokenizer.encode(t, add_special_tokens=False).ids
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * copies
    same(got(corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256")), want)


def test_very_long_texts(spark):
    """Texts beyond the steps in which hashes are made (1 MiB), near copies of each other."""
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200_000)]
    other = list(words)
    for k in range(0, 200_000, 400):
        other[k] = "x"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1])), (4, " ".join(words[1000:1050]))]
    assert len(rows[0][1]) > 1 << 20
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(got(jaccard_join.components(d)), brute.components(rows))
    same(got(suffix_dedup.digest(d)), brute.removal_digest(rows))


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, an extra column, and no rows at all."""
    import corpus_pipeline

    text = lambda k: " ".join(chr(97 + k % 26) + chr(97 + k // 26) + chr(97 + i) for i in range(20))
    rows = [(k, text(k), "en", "s", len(text(k))) for k in range(40)] + [(None, text(50), None, None, None), (60, None, None, None, None), (61, "", "en", "s", 0), (62, text(3), "de", None, 5), (63, text(63), None, None, None)]
    d = spark.createDataFrame([*rows, rows[5]], DOC).withColumns({"_id": F.lit(1), "extra": F.lit("x")})
    for name, df in (("a", d), ("b", d.limit(0))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a"))
    ids = {r["doc_id"] for r in out.collect()}
    assert ids <= {None, 63, *range(40)} and len(ids) > 10
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).columns == out.columns
    docs = spark.read.parquet(str(tmp_path / "b" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path / "b"))
        assert docs.count() == 0


def test_small_shards_are_put_in_order_together(monkeypatch):
    """A block sends a shard to each bucket: many small ones are one sort, with the same transforms."""
    from ambiquant.llm import suffix_dedup as sd

    rng = np.random.default_rng(21)
    shards = [[bytes(rng.integers(97, 100, int(rng.integers(50, 90))).astype(np.uint8)) for _ in range(int(rng.integers(1, 4)))] for _ in range(300)]
    shards[7] = shards[8] = shards[9]
    shards[20] = [b"a" * 4000] * 30
    want, calls, order = [sd.transform(x) for x in shards], [], sd.suffix_order
    monkeypatch.setattr(sd, "suffix_order", lambda text: calls.append(len(text)) or order(text))
    for together in (1, 5000, sd.TOGETHER):
        monkeypatch.setattr(sd, "TOGETHER", together)
        calls.clear()
        assert sd.transforms(shards) == want and sd.transforms([]) == []
    assert len(calls) < 10
