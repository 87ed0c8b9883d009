"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: each source has a weight; the total budget is shared by weight, a source gets
at most `max_epochs` times its size, and what is over is reshared by weight until no
source is above (water filling, solved in one pass over the sources sorted by
cap / weight).  A source first gives whole epochs; the rest of its target is taken from
a weighted random order without replacement: a document's key is Exp(1) / weight, and
documents are taken in ascending key order until the budget is used; the document that
crosses it is taken in part.

The prefix sums are distributed: documents fall in key ranges of a source, of equal width on a
logarithmic scale so that the weights' scale doesn't matter (`bins` says how fine); range
totals are summed before their shuffle, and only the documents of the one range that a
source's budget ends in are ordered.  No task gets the rows of a source.

Defined results: null text has size 0 and takes no words; a null source is a source of
its own and sorts last; keys are hashes of doc_id, the text's hash and a seed, so reruns
agree; a null doc_id hashes as null; equal keys are taken in doc_id order, repeated rows
together.  An empty table gives an empty result; extra columns, whatever their names, are kept by
`mix_documents` and ignored by `mix`.

The text is read once: keys and sizes, some 50 bytes a document, are kept in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambiquant.llm.quality import SYMBOLS, lines_of, words_of
from ambiquant.llm.session import checkpointed, unused


def quality_weight(text: Column, words: Column) -> Column:
    """From 1 for plain prose down to 0.05: the share of words free of symbols, times the share of
    lines that are no repeats, times how near the mean length of a word is to that of prose (3 to 12)."""
    size = F.greatest(F.lit(1), F.size(words))
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS))
    lines = lines_of(text)
    fresh = F.when(F.size(lines) > 0, F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(1.0))
    mean = F.greatest(F.lit(1), F.length(F.array_join(words, ""))) / size
    length = F.least(F.lit(1.0), mean / F.lit(3.0), F.lit(12.0) / mean)
    return F.greatest(F.lit(0.05), F.greatest(F.lit(0.0), F.lit(1.0) - symbols / size) * fresh * length)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """_source, source_size, weight, target; sizes: _source and source_size, one row a source.

    The windows here have no partition: their rows are sources, not documents.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    s = sizes.withColumn("weight", w).withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    s = s.withColumn("_budget", F.sum("source_size").over(all_rows).cast("double") * F.lit(float(share)))
    by = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if just the sources before this one in the order were at their caps
    s = s.withColumn(
        "_level",
        (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    s = s.withColumn("_level", F.min(F.when(F.col("_cap") / F.col("weight") > F.col("_level"), F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(all_rows)["_level"])
    level = F.col("weight") * F.col("_level")
    return s.withColumn("target", F.when(F.col("_level").isNull() | (level > F.col("_cap")), F.col("_cap")).otherwise(level)).select(
        "_source", "source_size", "weight", "target"
    )


def range_of(key: Column, bins: int) -> Column:
    """The range of a key: an eighth of `bins` for each doubling, so that the densest has some twice the even share of keys, whatever the weights' scale."""
    return F.floor(F.log2(key) * F.lit(bins / 8)).cast("int")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, bins: int = 4096, seed: int = 17, quality: str | None = None
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (whole copies), part (words of the last copy), taken, text_hash.

    quality: the column of docs with the documents' quality weights, above 0; nulls and others
    count as 1.  Without one `quality_weight` is taken.
    """
    d = docs.select(
        "doc_id", F.col("source").alias("_source"), F.col("text").alias("_text"), words_of(F.col("text")).alias("_words"),
        (F.col(quality).cast("double") if quality else F.lit(None).cast("double")).alias("_given"),
    )
    own = F.when(F.col("_given") > 0, F.col("_given")).otherwise(F.lit(1.0)) if quality else quality_weight(F.col("_text"), F.col("_words"))
    d = d.withColumns({"size": F.size("_words").cast("bigint"), "_quality": own, "text_hash": F.xxhash64("_text")})
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("_text", F.lit("")))))
    # 48 bits of the hash, in (0, 1)
    u = (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))
    d = d.withColumn("_key", -F.log(u) / F.col("_quality")).drop("_text", "_words", "_given", "_quality")
    d = d.withColumn("_bin", range_of(F.col("_key"), bins))
    d = checkpointed(d)
    per_bin = d.groupBy("_source", "_bin").agg(F.sum("size").alias("_sum"))
    in_source = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("_before", F.coalesce(F.sum("_sum").over(in_source), F.lit(0)))
    t = targets(per_bin.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    t = t.withColumn("epochs", F.least(F.lit(max_epochs), F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))).cast("bigint"))
    t = t.withColumn("_rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")))
    t = t.withColumnRenamed("_source", "_source2")
    b = per_bin.join(t, F.col("_source").eqNullSafe(F.col("_source2"))).select(
        F.col("_source").alias("_source2"), F.col("_bin").alias("_bin2"), "_sum", "_before", "source_size", "target", "epochs", "_rest"
    )
    d = d.join(b, F.col("_source").eqNullSafe(F.col("_source2")) & (F.col("_bin") == F.col("_bin2")))
    crossing = (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest"))
    sure = d.filter(~crossing).withColumn("part", F.when(F.col("_before") < F.col("_rest"), F.col("size")).otherwise(F.lit(0)))
    run = Window.partitionBy("_source", "_bin").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = d.filter(crossing).withColumn("_prior", F.col("_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    ordered = ordered.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_prior")))).drop("_prior")
    return sure.unionByName(ordered).select(
        "doc_id", F.col("_source").alias("source"), "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "epochs",
        F.col("part").cast("bigint").alias("part"), (F.col("epochs") * F.col("size") + F.col("part")).cast("bigint").alias("taken"), "text_hash",
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    A last copy that is taken in part is given whole if at least half of it is taken.
    Documents without words are never taken.  Rows that agree in doc_id, text and source get
    equal numbers of copies, the mean of theirs.
    """
    number, hashed, origin, copies, nth = unused(docs, "_id", "_hash", "_origin", "_copies", "_copy")
    taken = F.col("epochs") + F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)
    m = mix(docs, **options).filter("size > 0").groupBy("doc_id", "text_hash", "source").agg(F.round(F.avg(taken)).cast("int").alias(copies))
    m = m.filter(F.col(copies) > 0).withColumnsRenamed({"doc_id": number, "text_hash": hashed, "source": origin})
    same = F.col("doc_id").eqNullSafe(F.col(number)) & (F.xxhash64("text") == F.col(hashed)) & F.col("source").eqNullSafe(F.col(origin))
    return docs.join(m, same).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
