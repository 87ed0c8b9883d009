"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambiquant.llm import bpe, chat, jaccard_join, licenses, mixing, periodic_runs, quality, suffix_dedup, supermers, token_counts, topk, toxicity
from ambiquant.llm.sql import CHAT_SQL, JACCARD_SQL, MIX_SQL, QUALITY_SQL, RUNS_SQL, SUFFIX_SQL, TOPK_SQL, WINDOWS_SQL, license_sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits that follow from its length and id."""
    d = _read(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda at, length, text: F.struct(
        at.cast("bigint").alias("start"), F.lit(length).cast("bigint").alias("length"), F.lit(text).alias("text")
    )
    edits = F.array(edit(n / 3, 17, ""), edit(n / 2, 0, " and more"), edit(F.pmod(F.coalesce("doc_id", F.lit(0)) * 7919, n + 1), 5, "12 o'clock"))
    return token_counts.count_with_edits(d.select("doc_id", "text", edits.alias("edits")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_read(spark, sf_dir, "documents")).drop("removed", "_row")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model, cuts = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, cuts)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_conversations(turns))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.with_periodic_tails(_read(spark, sf_dir, "documents")))


def op12_supermers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supermers.digest(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_bpe, op4_quality, op5_mix, op6_toxicity, op7_jaccard_join, op8_topk, op9_chat, op10_licenses, op11_periodic_runs, op12_supermers)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": SUFFIX_SQL, "op4_quality": QUALITY_SQL, "op5_mix": MIX_SQL, "op7_jaccard_join": JACCARD_SQL, "op8_topk": TOPK_SQL, "op9_chat": CHAT_SQL,
        "op10_licenses": license_sql(licenses.TEMPLATES | licenses.FULL_TEXTS), "op11_periodic_runs": RUNS_SQL, "op12_supermers": WINDOWS_SQL,
    }
