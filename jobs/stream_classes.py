"""Abundances by sample from alignment files as they arrive.

    python -m jobs.stream_classes --alignments PATHS --features PATH --samples PATH --out DIR --checkpoint DIR

A sequencing run delivers alignment files over hours; users want counts and abundances of
what has come so far without filtering all files anew.  A run takes the files that the
stream's checkpoint doesn't know yet (all that are there, then it ends), filters their alignments to
sets of candidate features, compacts reads to classes by sample, and writes

    increments/batch=N/group=S   classes and numbers of reads of one micro-batch
    classes/group=S              classes and numbers of reads of all batches
    abundances/group=S           unique hits, reads and abundance (EM) of each feature

Increments are overwritten by batch number, so a batch that is done again after a crash
counts once; the other two are made anew from increments, which are as small as classes are.  A
run without new files leaves the same rows.

PATHS is a folder, or a pattern of files and folders (one file is a pattern too: its name and
a star).  The alignments of a read must lie in one file, as name-grouped files have them.  Alignments
to a reference that `features` doesn't have, or with a null reference, are left out and counted in the log;
reads that `samples` doesn't have belong to a null sample.  Empty inputs give no rows.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import partial
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambiquant.operators import alignments as al
from ambiquant.operators import classes as cl
from ambiquant.plans import abundance

log = logging.getLogger("jobs.stream_classes")
CONFIG = Path(__file__).with_suffix(".json")
INCREMENTS = "sample string, members array<string>, k bigint, batch bigint, group string"
ABUNDANCES = "sample string, feature string, unique_hits bigint, reads bigint, mu double, group string"


def group_of(sample: Column) -> Column:
    """The partition of a sample: names after a sign, so null, empty and numeric ones stay apart."""
    return F.coalesce(F.concat(F.lit("="), sample.cast("string")), F.lit("none"))


def named(df: DataFrame, expressions: dict[str, str], *names: str) -> DataFrame:
    return df.select(*[F.expr(expressions[n]).alias(n) for n in names])


def classes_of(alignments: DataFrame, features: DataFrame, samples: DataFrame, config: dict) -> DataFrame:
    """sample, members, k of the alignments of whole reads."""
    a = named(alignments, config["alignments"], "read", "reference", "isize", "nm", "ordinal")
    known = named(features, config["features"], "reference", "transcript").dropDuplicates()
    sets = al.pipeline(a.join(known, "reference"), config["insert_size"]["expected"], config["insert_size"]["threshold"])
    owner = named(samples, config["samples"], "read", "sample").dropDuplicates()
    owned = sets.join(owner, "read", "left").withColumn("sample", F.col("sample").cast("string"))
    return owned.groupBy("sample", F.col("transcripts").alias("members")).agg(F.count(F.lit(1)).alias("k"))


def write_increment(batch: DataFrame, number: int, features: DataFrame, samples: DataFrame, config: dict, out: str) -> None:
    """Classes of one micro-batch, in the partitions of its number."""
    found = classes_of(batch, features, samples, config).withColumns({"batch": F.lit(number), "group": group_of(F.col("sample"))})
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "group").parquet(f"{out}/increments")
    reference = F.expr(config["alignments"]["reference"]).alias("reference")
    lost = batch.select(reference).join(named(features, config["features"], "reference"), "reference", "left_anti").count()
    log.info("batch %d: read %d alignments, %d of them to unknown references", number, batch.count(), lost)


def abundances_of(classes: DataFrame, features: DataFrame, config: dict) -> DataFrame:
    """sample, feature, unique_hits, reads, mu: samples share no class, so one EM serves all."""
    name = lambda c: F.concat(group_of(F.col("sample")), F.lit("\u0001"), c)
    rows = classes.select("sample", F.explode("members").alias("feature"), "k", F.size("members").alias("size"))
    counts = rows.groupBy("sample", "feature").agg(F.sum(F.when(F.col("size") == 1, F.col("k")).otherwise(0)).alias("unique_hits"), F.sum("k").alias("reads"))
    counts = counts.withColumn("transcript", name(F.col("feature")))
    length = features.groupBy(F.expr(config["features"]["transcript"]).alias("feature")).agg(F.expr(config["features"]["length"]).alias("l"))
    own = classes.select(F.transform("members", name).alias("members"), "k").select(cl.key_of().alias("class_id"), "members", "k")
    mu = abundance.em_fixed(own, counts.join(length, "feature").select("transcript", "l"), config["em_steps"])
    return counts.join(mu.select("transcript", "mu"), "transcript", "left").select("sample", "feature", "unique_hits", "reads", "mu")


def run(spark: SparkSession, alignments: str, features: str, samples: str, out: str, checkpoint: str, config: dict) -> None:
    """Takes what is new under `alignments`; see the module."""
    known, owner = spark.read.parquet(features), spark.read.parquet(samples)
    stream = spark.readStream.schema(spark.read.parquet(alignments).schema).option("maxFilesPerTrigger", config["files_per_trigger"]).parquet(alignments)
    query = (
        stream.writeStream.foreachBatch(partial(write_increment, features=known, samples=owner, config=config, out=out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    log.info("read %s: %d new rows in %d batches", alignments, sum(p["numInputRows"] for p in query.recentProgress), len(query.recentProgress))
    try:
        increments = spark.read.schema(INCREMENTS).parquet(f"{out}/increments")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.info("%s: nothing has come yet", out)
        return
    total = increments.groupBy("group", "sample", "members").agg(F.sum("k").alias("k"))
    total.write.mode("overwrite").partitionBy("group").parquet(f"{out}/classes")
    classes = spark.read.schema("sample string, members array<string>, k bigint, group string").parquet(f"{out}/classes")
    found = abundances_of(classes.drop("group"), known, config).withColumn("group", group_of(F.col("sample")))
    found.write.mode("overwrite").partitionBy("group").parquet(f"{out}/abundances")
    n = classes.agg(F.count(F.lit(1)), F.sum("k")).first()
    log.info("wrote %s: %d classes of %d reads, %d abundances", out, n[0], n[1] or 0, read(spark, out).count())


def read(spark: SparkSession, out: str) -> DataFrame:
    """sample, feature, unique_hits, reads, mu as they stand."""
    return spark.read.schema(ABUNDANCES).parquet(f"{out}/abundances").drop("group")


def main() -> None:
    from ambiquant.session import build, ship

    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("alignments", "features", "samples", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build("stream-classes")
    try:
        ship(spark)
        run(spark, a.alignments, a.features, a.samples, a.out, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
