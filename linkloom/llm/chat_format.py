r"""Chat formatting by prefix-target expansion. DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that
reply is trainable. Turns behind the last reply (and conversations without one) become one more
example in which nothing is trainable, so no turn is lost.

The template is ``### role: text</turn>\n`` for each turn. Inside texts and roles a backslash is
written ``\b``, ``#`` ``\h``, ``<`` ``\l``, and inside roles ``:`` ``\c``; so no control string can
occur inside them, and replacing them back, the backslash last, restores the text exactly.

Examples hold their context in full, as the method asks: a conversation of n turns gives text of order
n squared, one example at a time. One conversation must fit in a row, since one example does.

Defined cases: null texts and roles are empty; turns are ordered by turn, nulls first, ties by role
and text; repeated rows are repeated turns; a null conv_id is a conversation of its own; other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BEGIN, COLON, END = "### ", ": ", "</turn>\n"
TARGET_ROLE = "assistant"
EXTRA_ID, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"


def escape(text: Column, role: bool = False) -> Column:
    for raw, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")) + ((":", "\\c"),) * role:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for raw, code in ((":", "\\c"),) * role + (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``example``, ``text`` and the code points [``loss_start``, ``loss_end``) that are trainable.

    ``is_last`` marks the example that holds all turns of its conversation.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(BEGIN), escape(t["role"], True), F.lit(COLON))
    body = lambda t: escape(t["text"])
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == TARGET_ROLE).alias("target"), head(t).alias("head"), body(t).alias("body"))).alias("parts"))
    whole = parts.select("conv_id", "parts", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))).alias("pieces"))
    n = F.size("parts")
    #: Where each turn ends in the whole text.
    ends = F.aggregate("pieces", F.expr("cast(array() as array<int>)"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(p))))
    placed = whole.select("conv_id", "parts", n.alias("n"), F.array_join("pieces", "").alias("all"), ends.alias("ends"))
    wanted = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("parts", i)["target"] | (i == F.col("n") - 1))
    each = placed.select("conv_id", "n", "all", F.explode(F.transform(wanted, lambda i: F.struct(
        i.alias("i"), F.get("parts", i)["target"].alias("target"), F.get("ends", i).alias("end"), F.length(F.get("parts", i)["body"]).alias("size")))).alias("x"))
    stop = F.col("x.end") - len(END)
    return each.select("conv_id", F.col("x.i").alias("example"), F.substring("all", F.lit(1), F.col("x.end")).alias("text"),
                       F.when(F.col("x.target"), stop - F.col("x.size")).otherwise(0).alias("loss_start"), F.when(F.col("x.target"), stop).otherwise(0).alias("loss_end"), (F.col("x.i") == F.col("n") - 1).alias("is_last"))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples hold, read back from their texts."""
    pieces = F.transform(F.filter(F.split("text", END), lambda p: p != ""), lambda p: F.substring(p, F.lit(len(BEGIN) + 1), F.length(p)))
    role = lambda p: F.substring_index(p, COLON, 1)
    turn = lambda p: F.concat(unescape(role(p), True), F.lit("\n"), unescape(F.substring(p, F.length(role(p)) + (len(COLON) + 1), F.length(p))), F.lit("\n"))
    reply = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = examples.select("conv_id", "example", F.length("text").cast("long").alias("chars"), F.when(F.col("loss_end") > 0, reply).alias("reply"),
                           F.when(F.col("is_last"), C.let(pieces, lambda p: F.struct(F.size(p).cast("long").alias("n"), F.sha2(F.array_join(F.transform(p, turn), "").cast("binary"), 256).alias("sha")))).alias("turns"))
    by = read.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"))
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return by.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(EXTRA_TEXT).alias("text"))
    return digest(expand(rows.unionByName(extra.select("conv_id", F.col("turn").cast("long"), "role", "text"))))
