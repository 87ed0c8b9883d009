"""Chat formatting with typed content parts (DataFrame functions only).

A conversation is a set of turns; a turn is a role and an ordered list of typed
parts (text, image, audio, document).  A visitor walks the parts in order and turns
each into template text: text parts are escaped, attachment parts become a numbered
placeholder ``<image:3>`` whose number counts the attachments of the conversation.
The formatted string, the loss mask (spans of assistant text), the attachment
references and the token count with expanded placeholders are returned.

Template of a turn: ``<turn:ROLE>`` newline, content, ``</turn>`` newline.  Every
control string starts with ``<``; inside texts and roles a backslash is written
``\\b`` and ``<`` is written ``\\l`` (roles also write ``>`` as ``\\g`` and a newline as
``\\n``), so texts can never contain a control string and the format can be reversed.

Defined results: a part of any other kind is an attachment too, with the placeholder
``<attachment:4>`` and its own kind in the references; a null kind is text; a null text is empty; a null role is empty; turns with a null turn
number come first; equal turn numbers are ordered by role and then by content;
repeated rows are repeated turns; an empty table gives an empty result.  Extra
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TYPE = "array<struct<kind:string,text:string,ref:string,n_tokens:bigint>>"
ATTACHMENTS = ("image", "audio", "document")


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape_text(c), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def text_parts(text: Column) -> Column:
    """One text part that holds the whole text."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("n_tokens"),
        )
    ).cast(PART_TYPE)


def _is_attachment(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) != "text"


def _placeholder(p: Column, ordinal: Column) -> Column:
    kind = F.when(p["kind"].isin(*ATTACHMENTS), p["kind"]).otherwise(F.lit("attachment"))
    return F.concat(F.lit("<"), kind, F.lit(":"), ordinal.cast("string"), F.lit(">"))


def _visit(before: Column, parts: Column) -> Column:
    """Pieces of a turn's content: text escaped, attachments as numbered placeholders."""
    ordinal = F.aggregate(
        parts,
        F.struct(before.cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("at")),
        lambda a, p: F.struct(
            (a["n"] + F.when(_is_attachment(p), 1).otherwise(0)).alias("n"),
            F.concat(a["at"], F.array(a["n"] + F.when(_is_attachment(p), 1).otherwise(0))).alias("at"),
        ),
    )["at"]
    text = F.transform(parts, lambda p: escape_text(F.coalesce(p["text"], F.lit(""))))
    # a turn of one part, the most common one, needs no array of ordinals
    one = F.when(_is_attachment(F.get(parts, F.lit(0))), F.array(_placeholder(F.get(parts, F.lit(0)), before + 1))).otherwise(text)
    pair = F.transform(F.arrays_zip(parts.alias("p"), ordinal.alias("n"), text.alias("t")), lambda z: F.when(_is_attachment(z["p"]), _placeholder(z["p"], z["n"])).otherwise(z["t"]))
    return F.array_join(F.when(F.size(parts) == 1, one).otherwise(pair), "")


def format_conversations(turns: DataFrame, parts: str | None = None, chars_per_token: int = 4) -> DataFrame:
    """Format conversations.

    turns: conv_id, turn, role and either text or the array column named by `parts`.
    Returns conv_id, formatted, n_turns, loss_spans (array of start/length in code
    points of `formatted`, 1-based), attachments (array of kind, ordinal, ref,
    n_tokens) and expanded_tokens: attachments count their own n_tokens, text counts
    a token for every `chars_per_token` code points begun in a part.

    One shuffle by conversation.  Turns are formatted one by one, with running sums of
    attachments and lengths over the sorted conversation, so the work is linear in its
    turns; a conversation is a row of the result, and so has to fit in a task.
    """
    content = F.coalesce(F.col(parts).cast(PART_TYPE), F.array().cast(PART_TYPE)) if parts else text_parts(F.col("text"))
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), content.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("own", F.filter("parts", _is_attachment))
    t = t.withColumns({"rn": F.row_number().over(order), "na": F.coalesce(F.sum(F.size("own")).over(before), F.lit(0))})
    t = t.withColumns({"head": F.concat(F.lit("<turn:"), escape_role(F.col("role")), F.lit(">\n")), "body": _visit(F.col("na"), F.col("parts"))})
    t = t.withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    t = t.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head") + 1)
    tokens = F.aggregate(
        "parts",
        F.lit(0).cast("bigint"),
        lambda a, p: a
        + F.when(_is_attachment(p), F.coalesce(p["n_tokens"], F.lit(0))).otherwise(
            F.ceil(F.length(F.coalesce(p["text"], F.lit(""))) / F.lit(chars_per_token))
        ),
    )
    span = F.when(F.col("role") == "assistant", F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("len")))
    conv = t.select("conv_id", F.struct("rn", "piece", span.alias("span"), "own").alias("t"), tokens.alias("tokens")).groupBy("conv_id")
    conv = conv.agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sum("tokens").alias("expanded_tokens"))
    return conv.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda x: x["piece"]), "").alias("formatted"),
        F.size("ts").cast("bigint").alias("n_turns"),
        F.filter(F.transform("ts", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.transform(
            F.flatten(F.transform("ts", lambda x: x["own"])),
            lambda p, i: F.struct(
                p["kind"].alias("kind"), (i + 1).alias("ordinal"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens")
            ),
        ).alias("attachments"),
        "expanded_tokens",
    )


def _cut(formatted: str) -> list[Column]:
    """_role and _body, arrays of the turns' roles and bodies, still escaped."""
    # roles escape < and >; a body may hold placeholders, never </turn>
    turn = r"<turn:([^<>]*)>\n" + r"((?:[^<]++|<(?!/turn>))*+)</turn>\n"
    return [F.regexp_extract_all(formatted, F.lit(turn), F.lit(k)).alias(n) for k, n in ((1, "_role"), (2, "_body"))]


def parse_formatted(df: DataFrame) -> DataFrame:
    """Read turns back from `formatted`: adds turns, an array of role and text."""
    return df.select("*", *_cut("formatted")).withColumn(
        "turns",
        F.transform(
            F.arrays_zip("_role", "_body"),
            lambda z: F.struct(unescape_role(z["_role"]).alias("role"), unescape_text(z["_body"]).alias("text")),
        ),
    ).drop("_role", "_body")


def digest(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output.

    Each conversation is cut into turns once; where a turn's body lies follows from running sums of
    lengths, and a body is under the mask if a span of it starts and ends there.  So the work is linear in
    turns.  A span that is no body raises an error.
    """
    d = df.select("conv_id", F.length("formatted").cast("bigint").alias("chars"), F.size("loss_spans").alias("spans"), *_cut("formatted"))
    t = d.select("conv_id", "chars", "spans", F.posexplode_outer(F.arrays_zip("_role", "_body")).alias("n", "z"))
    t = t.select("conv_id", "chars", "spans", "n", F.col("z._role").alias("role"), F.col("z._body").alias("body"))
    # a turn is <turn:role>, a line break, its body, </turn> and a line break
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("role") + F.length("body") + 16).over(before), F.lit(0)) + F.length("role") + 9)
    span = df.select(F.col("conv_id").alias("_id"), F.explode("loss_spans").alias("s")).select("_id", F.col("s.start").alias("_start"), F.col("s.len").alias("_len"))
    t = t.join(span, F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_start")) & (F.length("body") == F.col("_len")), "left")
    turn = F.struct("n", unescape_role(F.col("role")).alias("role"), unescape_text(F.col("body")).alias("text"), F.col("_start").isNotNull().alias("loss"))
    conv = t.groupBy("conv_id").agg(F.max("chars").alias("chars"), F.max("spans").alias("spans"), F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), turn))).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.filter("turns", lambda t: t["loss"])
    loss = F.when(F.size(learned) == F.col("spans"), F.array_join(F.transform(learned, lambda t: t["text"]), "")).otherwise(F.raise_error(F.lit("a loss span is no turn's body")).cast("string"))
    return conv.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )
