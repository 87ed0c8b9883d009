"""A training-corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents; the last returns a digest of the tokens of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ambiquant.llm import bpe, jaccard_join, mixing, quality, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject, and without lines that a host repeats too often; see llm.quality for nulls and ties."""
    return quality.filter_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of linked ones; a null doc_id links with nothing and stays."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that a smaller doc_id has; documents that lose everything stay, with an empty text."""
    return suffix_dedup.dedup_documents(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are never taken, a null source is one of its own."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A digest of the tokens of each row; a null text has no tokens."""
    return bpe.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup_stage),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: Near-duplicate classes, suffix merging and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Lineage is cut after each by a checkpoint in the shared folder."""
    from ambiquant.llm.session import checkpointed

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
