"""A reference catalogue from a table of sequences: lengths, groups, identical sequences, FASTA.

    python -m jobs.reference_catalogue --sequences PATH --out DIR

What quantification needs to know of its features before any read comes.  Written by
group of features:

    features/group=G   length, effective length, and the first of the features with the same sequence
    fasta/group=G      sequences in lines of `width`
    identical          sequences that several features share: how many, and of how many groups
    conflicts          features that several groups claim, which a quantification must not have

All four are overwritten whole, so a second run leaves the same rows.  Sequences go to no
shuffle, only their hashes do; a sequence that a third of all features share is met by a
broadcast of at most SHARES rows.

A null sequence has length 0, no identical ones and an empty FASTA entry; null names and
groups are kept.  Repeated rows are features of one name with one sequence, and counted as such.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambiquant.functions.statistics import effective_lengths
from ambiquant.operators import classes as cl
from ambiquant.sources import sequences as src

log = logging.getLogger("jobs.reference_catalogue")
CONFIG = Path(__file__).with_suffix(".json")
FEATURES = "transcript string, gene string, true_length int, effective_length double, identical_to string, n_identical bigint, group string"


def features_of(sequences: DataFrame, config: dict) -> DataFrame:
    """transcript, gene, seq, true_length, effective_length and the partition of the gene."""
    named = sequences.select(*[F.expr(config[n]).cast("string").alias(n) for n in ("transcript", "gene", "seq")])
    f = src.features_of(named).withColumn("true_length", F.coalesce("true_length", F.lit(0)))
    return f.withColumn("group", F.coalesce(F.concat(F.lit("="), "gene"), F.lit("none")))


def run(spark: SparkSession, sequences: str, out: str, config: dict) -> None:
    """Writes the catalogue of a table of sequences; see the module."""
    f = features_of(spark.read.parquet(sequences), config)
    log.info("read %s: %d sequences", sequences, f.count())
    known = cl.identical_firsts(f).drop("seq")
    table = effective_lengths(known, config["insert_size"]["mean"], config["insert_size"]["sd"])
    columns = [c.split(" ")[0] for c in FEATURES.split(", ")]
    table.select(columns).write.mode("overwrite").partitionBy("group").parquet(f"{out}/features")
    header = F.concat(F.lit(">"), F.coalesce("transcript", F.lit("")), F.lit(" gene:"), F.coalesce("gene", F.lit("")), F.lit("\n"))
    entry = F.concat(header, src.wrapped(F.coalesce("seq", F.lit("")), config["width"])).alias("value")
    f.select(entry, "group").write.mode("overwrite").partitionBy("group").text(f"{out}/fasta")
    written = spark.read.schema(FEATURES).parquet(f"{out}/features")
    same = written.filter("n_identical > 1").groupBy(F.col("identical_to").alias("first"))
    same.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group").alias("genes")).write.mode("overwrite").parquet(f"{out}/identical")
    cl.multiple_genes(written).write.mode("overwrite").parquet(f"{out}/conflicts")
    groups = written.agg(F.count(F.lit(1)), F.count_distinct("group"), F.count_if(F.col("n_identical") > 1)).first()
    claimed = spark.read.parquet(f"{out}/conflicts").count()
    log.info("wrote %s: %d features of %d groups, %d with identical ones, %d in several groups", out, *groups, claimed)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The features as they stand."""
    return spark.read.schema(FEATURES).parquet(f"{out}/features").drop("group")


def main() -> None:
    from ambiquant.session import build, ship

    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("sequences", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build("reference-catalogue")
    try:
        ship(spark)
        run(spark, a.sequences, a.out, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
