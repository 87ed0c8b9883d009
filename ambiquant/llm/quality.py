"""Quality rules with cross-document line frequency (DataFrame functions only).

A document passes base rules on its own words, then loses the lines that too many
documents of its host repeat, and is rejected if too little is left.

Lines are normalised (lower case, digits as 0, white space runs as one space, ends
trimmed) and identified by 64-bit hashes.  For each host (the source column; null is a
host of its own) and line, the distinct documents that hold the line are counted.  A
document is identified by a 64-bit hash of its whole text, so exact copies count once and
documents that share several lines count each.  Lines in more than `least_docs` documents
and more than a share `max_share` of a host's distinct documents are removed there, so the
rule is alike at every size.

Defined results: a null or empty text has no words and no lines, and fails the base
rules; null doc_id is a document like any other; repeated rows get equal results each.
Extra columns, whatever their names, are ignored by `measure` and kept by `filter_documents`;
an empty table gives an empty result.

The text is read once: hashes and word counts of lines, some hundredths of the text, are
kept in a checkpoint, which the counts and the removal are made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambiquant.llm.session import checkpointed, unused

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Rows of a hot (host, line) are dealt to so many tasks when removals are sent back.
SALTS = 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(NOT_SPACE))


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " "))


def base_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to doc_id and text."""
    d = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines_of(F.col("text"))})
    d = d.withColumn("_n", F.size("_words"))
    gram = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
    d = d.withColumn(
        "_grams",
        F.when(F.col("_n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), gram)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    # windows sorted with their places, only where some window repeats
    pairs = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), pairs))
    twin = lambda e, i: (e["g"] == F.get("_sorted", i - 1)["g"]) | (e["g"] == F.get("_sorted", i + 1)["g"])
    d = d.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", twin), lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(p - F.get("_at", i - 1), F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    d = d.withColumns(
        {
            "n_words": F.col("_n").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_words", "_n", "_grams", "_sorted", "_at")


def repeated_lines(docs: DataFrame, least_docs: int, max_share: float) -> DataFrame:
    """_host, _hash, n_docs of the lines that too many distinct documents of a host hold.

    docs: _host, _doc, the hash of a document's text, and _hashes, the array of its line hashes.
    All aggregations are summed before their shuffle, the first by document, so no line is hot.
    """
    hosts = docs.select("_host", "_doc").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    d = docs.select("_host", "_doc", F.explode(F.array_distinct("_hashes")).alias("_hash"))
    each = d.groupBy("_host", "_hash", "_doc").agg(F.lit(1).alias("_one"))
    lines = each.groupBy("_host", "_hash").agg(F.sum("_one").alias("n_docs")).filter(F.col("n_docs") > least_docs)
    return lines.join(hosts, "_host").filter(F.col("n_docs") > max_share * F.col("_all")).drop("_all")


def _row(docs: DataFrame) -> Column:
    """What identifies a row in the columns that the rules read; rows that agree in it get equal results."""
    return F.xxhash64(docs["doc_id"], docs["text"], docs["source"])


def measure(docs: DataFrame, least_docs: int = 20, max_share: float = 0.02, min_left: int = 30) -> DataFrame:
    """doc_id, the base measures, base_failed, n_lines, n_lines_removed, words_removed, removed and kept.

    removed: numbers, from 0, of the removed lines among the lines with a word.

    least_docs, max_share: documents of a host that may share a line, as a number and as a
    share of its distinct documents; the larger counts.  min_left: the percentage of a
    document's words that must be left after removal.
    """
    d = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_host"), _row(docs).alias("_row"))
    d = base_measures(d).withColumns(
        {
            "_doc": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
            "_hashes": F.transform("_lines", lambda x: F.xxhash64(normal(x))),
            "_counts": F.transform("_lines", lambda x: F.size(F.split(F.trim(F.regexp_replace(x, SPACE, " ")), " "))),
        }
    )
    d = checkpointed(d.drop("_lines", "text"))
    hot = repeated_lines(d, least_docs, max_share).select(
        "_host", "_hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    lines = d.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_row2"), "_host", F.posexplode(F.arrays_zip("_hashes", "_counts")).alias("_at", "_line"))
    lines = lines.select("_id", "_row2", "_host", "_at", F.col("_line._hashes").alias("_hash"), F.col("_line._counts").alias("_words"))
    lines = lines.withColumn("_salt", F.pmod("_row2", F.lit(SALTS)).cast("int"))
    # as a set, as repeated rows bring each line again
    removed = lines.join(hot, ["_host", "_hash", "_salt"]).groupBy("_id", "_row2").agg(F.collect_set(F.struct("_at", "_words")).alias("_gone"))
    d = d.join(removed, (F.col("_row") == F.col("_row2")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    d = d.withColumns(
        {
            "removed": F.coalesce(F.col("_gone._at"), F.array().cast("array<int>")),
            "n_lines": F.size("_hashes").cast("bigint"),
            "n_lines_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"),
            "words_removed": F.coalesce(F.aggregate("_gone", F.lit(0), lambda a, z: a + z["_words"]), F.lit(0)).cast("bigint"),
        }
    )
    left = F.col("n_words") - F.col("words_removed")
    enough = 100 * left >= min_left * F.col("n_words")
    # one expression over both sides of the join, so that a filter on it stays above the join
    kept = F.when(F.col("words_removed") >= 0, ~F.col("base_failed") & enough).otherwise(F.lit(False))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "n_lines", "n_lines_removed", "words_removed", "removed", "_row",
    )


def filter_documents(docs: DataFrame, least_docs: int = 20, max_share: float = 0.02, min_left: int = 30) -> DataFrame:
    """The kept documents with all their columns; over-frequent lines are cut from `text`.

    n_chars, if there is such a column, is counted anew.
    """
    number, row, row2, gone, lines, worded = unused(docs, "_id", "_row", "_row2", "_gone", "_lines", "_worded")
    m = measure(docs, least_docs, max_share, min_left).filter("kept").select(
        F.col("doc_id").alias(number), F.col("_row").alias(row2), F.col("removed").alias(gone)
    ).dropDuplicates([number, row2])
    d = docs.withColumn(row, _row(docs))
    d = d.join(m, (F.col(row) == F.col(row2)) & F.col("doc_id").eqNullSafe(F.col(number)))
    # numbers of the removed lines among all lines; arrays that are looked up by number are used twice
    # each, as the optimiser would put one that is used once into the loop, to be made anew for each line
    d = d.withColumn(lines, F.when(F.size(gone) > 0, F.split("text", "\n")))
    d = d.withColumn(worded, F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(NOT_SPACE), i)), lambda i: i.isNotNull()))
    d = d.withColumn(gone, F.when(F.size(worded) > 0, F.transform(gone, lambda i: F.get(worded, i))).otherwise(F.col(gone)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    d = d.withColumn("text", F.when(F.size(gone) > 0, rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast("bigint"))
    return d.select(*docs.columns)
