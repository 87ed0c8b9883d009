"""The jobs as queries: each runs twice over the whole tables into one new folder, and returns what then stands there."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambiquant.plans.proxy_sql import NEAR, ONE, PHI, STRATUM, A, _A0
from ambiquant.session import shared_folder
from jobs import reference_catalogue, stream_classes


def job1_stream_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "job1")
    for _ in range(2):
        stream_classes.run(
            spark, f"{sf_dir}/lineitem.parquet*", f"{sf_dir}/part.parquet", f"{sf_dir}/orders.parquet", f"{out}/out", f"{out}/checkpoint", json.loads(stream_classes.CONFIG.read_text())
        )
    return stream_classes.read(spark, f"{out}/out").withColumn("mu", F.round("mu", 6))


def job2_reference_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "job2")
    for _ in range(2):
        reference_catalogue.run(spark, f"{sf_dir}/documents.parquet", out, json.loads(reference_catalogue.CONFIG.read_text()))
    return reference_catalogue.read(spark, out).withColumn("effective_length", F.round("effective_length", 6))


def _em(steps: int) -> str:
    out = f"""WITH {A}, {STRATUM}, {ONE.format('s2', 's1')}, {NEAR.format('s3', 's2')},
r AS (SELECT read, list_sort(list(DISTINCT transcript)) AS ts FROM s3 GROUP BY 1),
c AS (SELECT coalesce('=' || o_orderpriority, 'none') AS g, o_orderpriority AS sample, ts, count(*) AS k FROM r LEFT JOIN orders ON read = o_orderkey GROUP BY ALL),
i AS (SELECT g, sample, ts, unnest(ts) AS transcript, k, len(ts) AS size FROM c),
n AS (SELECT g, any_value(sample) AS sample, transcript, CAST(sum(CASE WHEN size = 1 THEN k ELSE 0 END) AS BIGINT) AS unique_hits, CAST(sum(k) AS BIGINT) AS reads FROM i GROUP BY g, transcript),
l AS (SELECT p_brand AS transcript, round(avg(p_retailprice)) / 1000 AS l FROM part GROUP BY 1),
m0 AS (SELECT g, transcript, any_value(l) AS l, sum(k / size) / any_value(l) AS mu FROM i JOIN l USING (transcript) GROUP BY 1, 2)"""
    for k in range(1, steps + 1):
        out += f""", r{k} AS (SELECT g, ts, sum(mu) AS rate FROM i JOIN m{k - 1} USING (g, transcript) GROUP BY 1, 2),
m{k} AS (SELECT g, transcript, any_value(l) AS l, sum(mu * k / rate) / any_value(l) AS mu FROM i JOIN m{k - 1} USING (g, transcript) JOIN r{k} USING (g, ts) GROUP BY 1, 2)"""
    return out + f" SELECT sample, transcript AS feature, unique_hits, reads, round(mu, 6) AS mu FROM n JOIN m{steps} USING (g, transcript)"


SQL = {
    "job1_stream_classes": _em(3),
    "job2_reference_catalogue": f"""WITH {PHI}, f AS (SELECT CAST(doc_id AS VARCHAR) AS transcript, source AS gene, text, coalesce(length(text), 0) AS n FROM documents),
        s AS (SELECT text, min(transcript) AS first, count(*) AS copies FROM f WHERE text IS NOT NULL GROUP BY 1)
        SELECT transcript, gene, CAST(n AS INT) AS true_length,
          round(greatest(0.1::DOUBLE, coalesce((SELECT s FROM phi WHERE f = least(n, 420)), 0) + greatest(0, n - 420) - n * {_A0!r}::DOUBLE), 6) AS effective_length,
          coalesce(first, transcript) AS identical_to, coalesce(copies, 1) AS n_identical FROM f LEFT JOIN s USING (text)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_stream_classes, job2_reference_catalogue)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
