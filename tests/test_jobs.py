"""Jobs over growing copies of small tables, against plain versions and SQL."""

import collections
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobs import queries, reference_catalogue, stream_classes

SF = "/root/testdata/sf0.001"
LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double"


def config(job):
    return json.loads(job.CONFIG.read_text())


@pytest.fixture()
def tables(spark, tmp_path):
    parts = [(k, f"B{k % 4}", 100.0 + k) for k in range(12)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_retailprice double").write.parquet(str(tmp_path / "part"))
    orders = [(o, [None, "", "1", "x/y"][o % 4]) for o in range(40)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderpriority string").write.parquet(str(tmp_path / "orders"))
    return tmp_path


def lines(first, last):
    return [(o, (o * 7 + n * n) % 13, n, n, float(20 + n), 0.01 * ((o + n) % 3)) for o in range(first, last) for n in range(1 + o % 5)]


def expected(rows):
    """(sample, sorted brands) -> reads, by the filters one after another."""
    by = collections.defaultdict(list)
    for o, p, s, n, q, d in rows:
        if p < 12:
            by[o].append((round(d * 100), abs(int(q) - 25), n * 10**9 + p * 1000 + s, f"B{p % 4}"))
    out = collections.Counter()
    for o, a in by.items():
        low = min(x[0] for x in a)
        best = {}
        for x in sorted(x for x in a if x[0] == low):
            if x[3] not in best or (x[1], x[2]) < (best[x[3]][1], best[x[3]][2]):
                best[x[3]] = x
        near = [b for b, x in best.items() if x[1] <= 20] or list(best)
        out[[None, "", "1", "x/y"][o % 4] if o < 40 else None, tuple(sorted(near))] += 1
    return out


def classes(spark, out):
    d = spark.read.schema("sample string, members array<string>, k bigint").parquet(f"{out}/classes")
    return {(r["sample"], tuple(r["members"])): r["k"] for r in d.collect()}


def test_stream_takes_what_is_new(spark, tables):
    t, c = str(tables), config(stream_classes) | {"files_per_trigger": 1}
    run = lambda: stream_classes.run(spark, f"{t}/in", f"{t}/part", f"{t}/orders", f"{t}/out", f"{t}/ck", c)
    put = lambda rows: spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{t}/in")
    put([])
    run()
    assert stream_classes.read(spark, f"{t}/out").count() == 0
    put(lines(0, 20))
    put(lines(20, 30))
    run()
    assert classes(spark, f"{t}/out") == expected(lines(0, 30))
    before = sorted(map(repr, stream_classes.read(spark, f"{t}/out").collect()))
    batches = spark.read.parquet(f"{t}/out/increments").select("batch").distinct().count()
    run()  # nothing is new
    assert sorted(map(repr, stream_classes.read(spark, f"{t}/out").collect())) == before
    put(lines(30, 50))
    run()
    assert classes(spark, f"{t}/out") == expected(lines(0, 50))
    assert spark.read.parquet(f"{t}/out/increments").select("batch").distinct().count() == batches + 1
    found = {(r["sample"], r["feature"]): r for r in stream_classes.read(spark, f"{t}/out").collect()}
    for (sample, feature), r in found.items():
        own = {m: k for (s, m), k in expected(lines(0, 50)).items() if s == sample and feature in m}
        assert r["reads"] == sum(own.values()) and r["unique_hits"] == own.get((feature,), 0) and r["mu"] > 0


def test_a_batch_that_is_done_again_counts_once(spark, tables):
    t, c = str(tables), config(stream_classes)
    batch = spark.createDataFrame(lines(0, 40), LINES)
    for _ in range(2):
        stream_classes.write_increment(batch, 3, spark.read.parquet(f"{t}/part"), spark.read.parquet(f"{t}/orders"), c, f"{t}/out")
    assert spark.read.schema(stream_classes.INCREMENTS).parquet(f"{t}/out/increments").agg(F.sum("k")).first()[0] == sum(expected(lines(0, 40)).values())


def test_no_input_yet(spark, tables):
    t = str(tables)
    os.mkdir(f"{t}/in")
    spark.createDataFrame([], LINES).write.mode("overwrite").parquet(f"{t}/in")
    stream_classes.run(spark, f"{t}/in", f"{t}/part", f"{t}/orders", f"{t}/out", f"{t}/ck", config(stream_classes))


def test_catalogue(spark, tmp_path):
    hot = [(k, "same " * 20, "a" if k % 2 else "b", "x") for k in range(300)]
    rows = hot + [(1000, "abc", "a", "x"), (1001, "abc", "a", "x"), (1002, None, None, "x"), (1003, "", "", "x"), (1004, None, "1", "x"), (None, "lone", "b/c", "x"), (7, "other", "z", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _h string")
    d.write.parquet(str(tmp_path / "docs"))
    out, c = str(tmp_path / "out"), config(reference_catalogue) | {"width": 10}
    for _ in range(2):
        reference_catalogue.run(spark, str(tmp_path / "docs"), out, c)
        got = {}
        for r in reference_catalogue.read(spark, out).collect():
            got.setdefault(r["transcript"], []).append(r)
        assert sum(map(len, got.values())) == len(rows)
        same = [r for rs in got.values() for r in rs if r["true_length"] == 100]
        assert len(same) == 300 and {(r["identical_to"], r["n_identical"]) for r in same} == {("0", 300)}
        assert [(got[k][0]["identical_to"], got[k][0]["n_identical"]) for k in ("1000", "1001", "1002", "1003")] == [("1000", 2), ("1000", 2), ("1002", 1), ("1003", 1)]
        assert got["1002"][0]["gene"] is None and got["1003"][0]["gene"] == "" and got["1004"][0]["gene"] == "1" and got[None][0]["gene"] == "b/c"
        assert got["1002"][0]["true_length"] == 0
        assert {(r["first"], r["n"], r["genes"]) for r in spark.read.parquet(f"{out}/identical").collect()} == {("0", 300, 2), ("1000", 2, 1)}
        assert [r["transcript"] for r in spark.read.parquet(f"{out}/conflicts").collect()] == ["7"]
        lines = [r[0] for r in spark.read.text(f"{out}/fasta").select("value").collect()]
        assert len([x for x in lines if x.startswith(">")]) == len(rows) and max(len(x) for x in lines if not x.startswith(">")) == 10


def test_catalogue_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "docs"))
    reference_catalogue.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), config(reference_catalogue))
    assert reference_catalogue.read(spark, str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == sorted(repr(tuple(r)) for r in want)


def test_command_line(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.createDataFrame([(1, "abc", "a"), (2, "abc", "b")], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "docs"))
    done = subprocess.run([sys.executable, "-m", "jobs.reference_catalogue", "--sequences", str(tmp_path / "docs"), "--out", str(tmp_path / "out")], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0 and "2 features of 2 groups" in done.stderr
    assert {r["n_identical"] for r in reference_catalogue.read(spark, str(tmp_path / "out")).collect()} == {2}
    for job in ("stream_classes", "reference_catalogue"):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--help"], cwd=root, capture_output=True, text=True)
        assert done.returncode == 0 and "--out" in done.stdout
