"""Result tables, traces, incidence lists and design matrices as files."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = {"log_mu", "sd", "mcse", "iact", "effective_length", "mean_proportion", "mean_probit_proportion", "sd_probit_proportion", "log_mu_em"}
LONGS = {"true_length", "unique_hits", "observed", "ntranscripts"}


def read_quant(spark: SparkSession, path: str) -> DataFrame:
    """A result table: columns are found by name, NA is null, percentile lists become arrays."""
    raw = spark.read.csv(path, sep="\t", header=True, comment="#", nullValue="NA", inferSchema=False)
    out = []
    for c in raw.columns:
        name = re.sub(r"[\d.,]+$", "", c) if c.startswith("percentiles") else c
        col = F.col(f"`{c}`")
        if name.startswith("percentiles"):
            col = F.transform(F.split(col, ","), lambda x: F.when(x != "NA", x).cast("double"))
        elif name in DOUBLES:
            col = F.when(F.lower(col).isin("inf", "-inf", "nan"), F.when(F.lower(col) == "inf", float("inf")).when(F.lower(col) == "-inf", float("-inf")).otherwise(float("nan"))).otherwise(F.expr(f"try_cast(`{c}` AS double)"))
        elif name in LONGS:
            col = col.cast("bigint")
        out.append(col.alias(name))
    return raw.select(*out)


def mapped_fragments(spark: SparkSession, path: str) -> DataFrame:
    """n_mapped: the last word of the line on mapped fragments."""
    return spark.read.text(path).filter(F.col("value").startswith("# Mapped fragments")).select(F.regexp_extract("value", r"(\d+)\s*$", 1).cast("bigint").alias("n_mapped"))


def write_table(df: DataFrame, path: str, comment: str = "") -> None:
    """Tab-separated rows with a header; nulls as NA, arrays as comma lists; a comment is a part file of its own."""
    shown = [
        F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("NA"))), ",").alias(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c)
        for c in df.columns
    ]
    df.select(*shown).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")
    if comment:
        df.sparkSession.createDataFrame([(f"#{comment}",)], "value string").coalesce(1).write.mode("append").text(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """feature, iter, value of one trace file: a line of names, then a line for each iteration."""
    raw = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    cells = lambda x: F.filter(F.split(x, r"\s+"), lambda y: y != "")
    t = raw.select(lines.alias("l")).select(cells(F.get("l", F.lit(0))).alias("names"), F.posexplode(F.slice("l", F.lit(2), F.size("l"))).alias("iter", "row"))
    return t.select("iter", "names", cells(F.col("row")).alias("cells")).select("iter", F.explode(F.arrays_zip("names", "cells")).alias("z")).select(
        F.col("z")["names"].alias("feature"), "iter", F.col("z")["cells"].cast("double").alias("value")
    )


def write_traces(trace: DataFrame, path: str) -> None:
    (trace.write.mode("overwrite").partitionBy("sample") if "sample" in trace.columns else trace.write.mode("overwrite")).parquet(path)


def read_incidence(spark: SparkSession, incidence: str, counts: str | None = None) -> DataFrame:
    """class_id, feature and, with a file of counts, k, from an incidence list.

    The list has a line # with the names of features and lines of class and feature numbers; the
    file of counts has a number for each class, in order.
    """
    cells = F.filter(F.split(F.regexp_replace("value", "^#", ""), r"\s+"), lambda x: x != "")
    raw = spark.read.text(incidence).withColumn("_c", cells)
    named = raw.filter(F.col("value").startswith("#")).select(F.posexplode("_c").alias("feature_no", "feature"))
    pairs = raw.filter(~F.col("value").startswith("#") & (F.size("_c") == 2)).select(F.col("_c")[0].cast("bigint").alias("class_id"), F.col("_c")[1].cast("int").alias("feature_no"))
    found = pairs.distinct().join(named, "feature_no").select("class_id", "feature")
    if counts is None:
        return found
    k = spark.read.text(counts, wholetext=True).select(F.posexplode(cells).alias("class_id", "k")).select(F.col("class_id").cast("bigint").alias("class_id"), F.col("k").cast("bigint").alias("k"))
    return found.join(k, "class_id").select("class_id", "feature", "k")


def parse_matrices(text: str) -> list[np.ndarray]:
    """Matrices of a design file, separated by blank lines or comments."""
    out: list[list[list[float]]] = [[]]
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line:
            out[-1].append([float(x) for x in line.split()])
        elif out[-1]:
            out.append([])
    return [np.array(m) for m in out if m]


def adjusted_lengths(meta: DataFrame, lengths: DataFrame) -> DataFrame:
    """meta with lengths by transcript, else by transcript_A, else by transcript_B."""
    m = meta
    got = []
    for i, suffix in enumerate(("", "_A", "_B")):
        side = lengths.select(F.col("transcript").alias(f"_k{i}"), F.col("length").alias(f"_l{i}"))
        m = m.join(side, F.concat(F.col("transcript"), F.lit(suffix)) == F.col(f"_k{i}"), "left")
        got.append(F.col(f"_l{i}"))
    return m.withColumn("effective_length", F.coalesce(*got, "effective_length")).select(*meta.columns)
