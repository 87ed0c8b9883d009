"""Interval, as-of and membership joins on annotations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ambiquant.operators.selection import before

#: Width of the bins by which points find intervals.
BIN = 1 << 14


def exon_offsets(exons: DataFrame) -> DataFrame:
    """Adds before: the length of the exons that precede, by transcript and start."""
    w = Window.partitionBy("transcript_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w), F.lit(0)))


def points_in(points: DataFrame, intervals: DataFrame, key: str, point: str = "pos", width: int = BIN) -> DataFrame:
    """Points and the intervals (start to end, both within) of their key; an equi-join on bins."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    left = points.withColumn("_bin", F.floor(F.col(point) / width))
    return left.join(intervals.withColumn("_bin", bins), [key, "_bin"]).filter(F.col(point).between(F.col("start"), F.col("end"))).drop("_bin")


def spliced_positions(points: DataFrame, exons: DataFrame) -> DataFrame:
    """Offsets (0-based) in the spliced sequence of points given by transcript_id and pos."""
    return points_in(points, exon_offsets(exons), "transcript_id").withColumn("at", F.col("pos") - F.col("start") + F.col("before"))


def running_offset(events: DataFrame, probes: DataFrame, key: str = "chrom") -> DataFrame:
    """Probes (key, pos) with offset: the sum of delta of the events before pos.  A key is shared by tasks, see selection.before."""
    u = events.select(key, "pos", F.col("delta").cast("bigint").alias("delta"), F.lit(1).alias("_e"))
    u = u.unionByName(probes.select(key, "pos", F.lit(0).cast("bigint").alias("delta"), F.lit(0).alias("_e")))
    summed = before(u, key, ["pos", "_e"], "delta", F.sum, "offset").filter("_e = 0")
    return summed.select(key, "pos", F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset")).distinct()


def islands(intervals: DataFrame, order: list[str]) -> DataFrame:
    """Adds island: the first pos of the stretch of overlapping intervals (chrom, pos, last) that a row is in.

    A row opens an island if it starts after the last place of all rows before it; nothing overlaps across islands.
    """
    opened = before(intervals, "chrom", order, "last", F.max, "_reach").withColumn("_open", F.when(F.col("_reach").isNull() | (F.col("pos") > F.col("_reach")), F.col("pos")))
    held = before(opened, "chrom", order, "_open", F.max, "_held")
    return held.withColumn("island", F.coalesce("_open", "_held")).drop("_reach", "_open", "_held")


def boundary_map(indels: DataFrame, bounds: DataFrame) -> DataFrame:
    """chrom, pos, new_left, new_right of boundaries after indels (chrom, pos, ref, alt).

    A deletion that swallows a boundary moves its left side behind the deletion and its
    right side before it; only one boundary is swallowed by a deletion.  Only islands that have
    deletions and boundaries are scanned, in order, a task for each; elsewhere the offset is a sum.
    """
    d = indels.filter(F.length("ref") != F.length("alt")).select("chrom", F.col("pos").cast("int").alias("pos"), (F.length("alt") - F.length("ref")).alias("delta"), "ref", "alt")
    none = F.lit(None).cast("string")
    rows = d.withColumn("kind", F.lit(1)).unionByName(bounds.select("chrom", F.col("pos").cast("int").alias("pos"), F.lit(0).alias("delta"), none.alias("ref"), none.alias("alt"), F.lit(0).alias("kind")).distinct())
    rows = rows.withColumn("last", F.col("pos") + F.greatest(F.lit(0), -F.col("delta")))
    order = ["pos", "kind", "ref", "alt"]
    rows = before(islands(rows, order), "chrom", order, "delta", F.sum, "_offset").withColumn("offset", F.coalesce("_offset", F.lit(0)).cast("int"))
    each = Window.partitionBy("chrom", "island")
    scanned = rows.withColumn("_scan", (F.max(F.col("delta") < 0).over(each)) & (F.min("kind").over(each) == 0)).select("chrom", "pos", "delta", "kind", "island", "offset", "ref", "alt", "_scan")

    def scan(df: pd.DataFrame) -> pd.DataFrame:
        d = df.sort_values(order, kind="stable", na_position="first")
        pending, moved, shift = d["pos"][d["kind"] == 0].tolist(), [], int(d["offset"].iloc[0])
        i = 0
        for pos, delta in d[d["kind"] == 1][["pos", "delta"]].itertuples(index=False):
            while i < len(pending) and pending[i] <= pos:
                moved.append((pending[i], pending[i] + shift, pending[i] + shift))
                i += 1
            if delta < 0 and i < len(pending) and pending[i] <= pos - delta:
                moved.append((pending[i], pos + 1 + shift, pos + shift))
                i += 1
            shift += delta
        moved += [(p, p + shift, p + shift) for p in pending[i:]]
        return pd.DataFrame([(df["chrom"].iloc[0], *m) for m in moved], columns=["chrom", "pos", "new_left", "new_right"])

    plain = scanned.filter("NOT _scan AND kind = 0").select("chrom", "pos", (F.col("pos") + F.col("offset")).cast("int").alias("new_left"), (F.col("pos") + F.col("offset")).cast("int").alias("new_right"))
    return plain.unionByName(scanned.filter("_scan").groupBy("chrom", "island").applyInPandas(scan, "chrom string, pos int, new_left int, new_right int"))


def offset_exons(exons: DataFrame, indels: DataFrame) -> DataFrame:
    """Exons in the coordinates after the indels; those that end before they start are dropped."""
    bounds = exons.select("chrom", F.explode(F.array("start", "end")).alias("pos"))
    m = boundary_map(indels, bounds)
    left = m.select("chrom", F.col("pos").alias("start"), F.col("new_left").alias("_s"))
    right = m.select("chrom", F.col("pos").alias("end"), F.col("new_right").alias("_e"))
    moved = exons.join(left, ["chrom", "start"], "left").join(right, ["chrom", "end"], "left")
    moved = moved.withColumns({"start": F.coalesce("_s", "start"), "end": F.coalesce("_e", "end")})
    return moved.filter("end >= start").select(*exons.columns)


def without_overlaps(indels: DataFrame) -> DataFrame:
    """Indels by position, without those that overlap the last one kept in their island.

    Islands are dealt to tasks, which read theirs in order and hold one end at a time, so neither many islands nor a long one are a burden.
    """
    columns = indels.columns
    order = ["chrom", "island", "pos", "ref", "alt"]
    marked = islands(indels.withColumn("last", F.col("pos") + F.length("ref") - 1), ["pos", "ref", "alt"])
    dealt = marked.select(*columns, "island", "last").repartition("chrom", "island").sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reach = None, None
        for b in batches:
            keep = []
            for chrom, island, pos, last in zip(*(b.column(c).to_pylist() for c in ("chrom", "island", "pos", "last"))):
                ok = (chrom, island) != at or pos > reach
                if ok:
                    at, reach = (chrom, island), last
                keep.append(ok)
            yield b.select(columns).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(scan, indels.schema)


def spans(exons: DataFrame) -> DataFrame:
    """level, id, chrom, start, end of exons' transcripts and genes, by grouping sets."""
    g = exons.groupingSets([["chrom", "gene_id", "transcript_id"], ["chrom", "gene_id"]], "chrom", "gene_id", "transcript_id")
    s = g.agg(F.grouping_id().alias("_g"), F.min("start").alias("start"), F.max("end").alias("end"))
    gene = F.col("_g") > 0
    return s.select(F.when(gene, "gene").otherwise("transcript").alias("level"), F.when(gene, F.col("gene_id")).otherwise(F.col("transcript_id")).alias("id"), "chrom", "start", "end")


def only_known(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return rows.join(names.select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return rows.join(names.select(key).distinct(), key, "left_anti")
