"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Documents are counted in cells of source, language and topic. Token weights of the cells are raked, in
turn, to each margin's target; a weight is a probability, so weights over 1 are trimmed each round and
the rest raked on. Documents are then drawn by their cell's probability and a hash of their id.

A margin's target is its share of tokens to a power under 1, so large sources give way to small ones;
other targets can be given. A hot source is one cell's sum, aggregated before the shuffle. The table of
cells is as large as the margins have values together, not as there are documents: raking it is one
task of window functions without any shuffle, and it goes to the documents by a join whose side
adaptive execution broadcasts only if it is small.

Topics come from the column that a caller names, as a corpus with topics has one; without it they follow
from whole words that mark a kind of text, since the tables here have no topics.

Defined cases: null and empty texts have no tokens and take their cell's probability; null sources and
languages are values of their own; ties in topics go to the first listed; repeated rows are drawn alike;
texts of any length are counted whole; an empty table gives an empty table; other columns are handed
through untouched, one named ``topic`` too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SHARE = 0.5  # of all tokens that is to be drawn
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
ROUNDS = 10
TOPICS = {"legal": ("License.", "License,", "License", "Licensed", "Copyright", "copyright", "warranty"), "table": ("|",), "code": ("=", "{", "}", "def", "return", "token", "import")}
OTHER = "prose"


def topic_of(words: Column) -> Column:
    found = F.lit(OTHER)
    for name, marks in reversed(TOPICS.items()):
        found = F.when(F.arrays_overlap(words, F.array(*map(F.lit, marks))), name).otherwise(found)
    return found


def _described(docs: DataFrame, topic: str | None) -> DataFrame:
    def of(w: Column) -> Column:
        n = F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (w[F.size(w) - 1] == ""), 1).otherwise(0)
        return F.struct(n.cast("long").alias("n_tokens"), (F.col(topic).cast("string") if topic else topic_of(w)).alias("topic"))

    return docs.select(F.struct("*").alias("row"), "doc_id", "source", "lang", C.let(F.split(C.text_of(), rf"[{C.SPACE}]+"), of).alias("d"))


def rake(cells: DataFrame, share: float = SHARE, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``probability`` to cells with ``tokens``."""
    all_of = W.partitionBy()
    cells = cells.coalesce(1).withColumn("total", F.sum("tokens").over(all_of))
    for margin, power in powers.items():
        cells = cells.withColumn(f"_{margin}", F.sum("tokens").over(W.partitionBy(margin))).withColumn(f"_n{margin}", F.count("*").over(W.partitionBy(margin)))
        scaled = F.pow(F.col(f"_{margin}").cast("double"), F.lit(power))
        target = scaled / F.sum(scaled / F.col(f"_n{margin}")).over(all_of)
        cells = cells.withColumn(f"_{margin}", F.when(F.col(f"_{margin}") > 0, share * F.col("total") * target).otherwise(0.0))
    cells = cells.withColumn("p", F.lit(float(share)))
    for _ in range(rounds):
        for margin in powers:
            now = F.sum(F.col("p") * F.col("tokens")).over(W.partitionBy(margin))
            cells = cells.withColumn("p", F.when(now > 0, F.col("p") * F.col(f"_{margin}") / now).otherwise(F.col("p")))
        cells = cells.withColumn("p", F.least("p", F.lit(1.0)))
    return cells.select("source", "lang", "topic", F.round("p", 9).alias("probability"))


def draw_of(doc_id: Column, n_tokens: Column) -> Column:
    """A number from 0 to 1 from the MD5 of the id."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), n_tokens.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _mixed(docs: DataFrame, keep_rows: bool, topic: str | None = None, **how) -> DataFrame:
    columns = [F.col("row")] if keep_rows else []
    d = C.materialize(_described(docs, topic).select(*columns, "doc_id", "source", "lang", "d.topic", "d.n_tokens"), "described")
    cells = d.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    rates = C.materialize(rake(cells, **how), "rates").select(*[F.col(c).alias(f"r_{c}") for c in ("source", "lang", "topic")], "probability")
    same = F.col("source").eqNullSafe(F.col("r_source")) & F.col("lang").eqNullSafe(F.col("r_lang")) & F.col("topic").eqNullSafe(F.col("r_topic"))
    return d.join(rates, same).withColumn("kept", draw_of(F.col("doc_id"), F.col("n_tokens")) < F.col("probability"))


def weigh(docs: DataFrame, **how) -> DataFrame:
    """``doc_id``, its cell, ``n_tokens``, ``probability`` and whether it is ``kept``."""
    return _mixed(docs, False, **how).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def sample(docs: DataFrame, **how) -> DataFrame:
    """The rows that are drawn, with their columns and ``mix_probability``, in place of one that was there."""
    others = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "mix_probability"]
    return _mixed(docs, True, **how).filter("kept").select(*others, F.col("probability").alias("mix_probability"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(C.table(spark, sf_dir, "documents"))
