"""Queries against their SQL on the smallest tables, when those are there."""

import os

import pytest

import __spark_entry__ as entry
from ambiquant.plans import proxy

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(proxy.oracle_sql())))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    result = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(repr(tuple(r)) for r in result)


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0


def test_gibbs_summary_has_every_feature(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey").distinct().count()
    assert proxy.queries()["gibbs_summary"](spark, SF).count() == parts


def test_documents_are_taken_whole(spark, tmp_path):
    rows = [(None, "abc", 3), (1, "x" * 6000, 6000), (2, "y" * 5000, 5000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    q = proxy.queries()
    assert sorted(r["true_length"] for r in q["eff_length"](spark, str(tmp_path)).collect()) == [3, 5000, 6000]
    assert q["wrapped_lines"](spark, str(tmp_path)).count() == 3
