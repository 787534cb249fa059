"""The entity view: S1, S2 and S3 records from ``documents``, and what the queries build on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocking, decide, features
from ..sources import files

#: Candidates a query from each ranked channel, and another number for some countries.
WORD_K = CHAR_K = 100
BUDGETS = {"en": (50, 50)}
_WRITTEN: dict[tuple, str] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """A changed documents table is another name, by its size, files and time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = fs.getContentSummary(path)
    return spark.sparkContext.applicationId, name, sf_dir, state.getLength(), state.getFileCount(), fs.getFileStatus(path).getModificationTime()


def once(spark: SparkSession, sf_dir: str, name: str, plan) -> DataFrame:
    """What ``plan`` gives, written to the shared folder by its first reader; later plans of the session read that."""
    key = _key(spark, sf_dir, name)
    if key not in _WRITTEN:
        to = files.workspace(spark, name)
        plan().write.parquet(to)
        _WRITTEN[key] = to
    return spark.read.parquet(_WRITTEN[key])


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "entity-view", lambda: _entities(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five normalised tokens of a text are a name, the next twelve an address, its language a country."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", T.norm_blocking(F.coalesce("text", F.lit(""))).alias("norm"))
    # What stands behind the 17 tokens is split no further.
    toks = F.filter(F.split("norm", " ", 18), lambda t: t != "")
    src = (F.col("doc_id") % 3 + 1).cast("string")
    return docs.select(F.concat(F.lit("S"), src, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("src"), F.col("lang").alias("country"),
                       F.array_join(F.slice(toks, 1, 5), " ").alias("nname"), F.array_join(F.slice(toks, 6, 12), " ").alias("naddr"), F.md5(F.col("norm").cast("binary")).alias("whole"))


def raw(e: DataFrame) -> DataFrame:
    return e.withColumns({"business_name": F.col("nname"), "business_address": F.col("naddr")})


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = entities(spark, sf_dir)
    return e.filter("src = 1"), e.filter("src > 1")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links: equal whole texts in one country; a corpus record links to the smallest such S1 only."""
    q, c = sides(spark, sf_dir)
    first = q.groupBy("country", "whole").agg(F.min("entity_id").alias("s1_id"))
    return c.join(first, ["country", "whole"]).select("s1_id", F.col("entity_id").alias("cand_id"), "country")


def joint_grams():
    return blocking.word_grams(F.concat("nname", F.lit(" "), "naddr"))


def word_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "word-channel", lambda: blocking.tfidf_topk(*sides(spark, sf_dir), WORD_K))


def char_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "char-channel", lambda: blocking.tfidf_topk(*sides(spark, sf_dir), CHAR_K, joint_grams()))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of the three channels, word, char and exact."""
    def plan() -> DataFrame:
        return blocking.channel_union(word_channel(spark, sf_dir), char_channel(spark, sf_dir), blocking.exact_block(*sides(spark, sf_dir)))

    return once(spark, sf_dir, "candidates", plan)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.query_index(sides(spark, sf_dir)[0], candidates(spark, sf_dir))


def _pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = sides(spark, sf_dir)
    return features.pair_features(candidates(spark, sf_dir), raw(q), raw(c))


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "features", lambda: _pair_features(spark, sf_dir))


def some_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``pair_features``, for readers of a part: where those aren't written yet, only the columns that are read are computed."""
    return pair_features(spark, sf_dir) if _key(spark, sf_dir, "features") in _WRITTEN else _pair_features(spark, sf_dir)


def probability() -> Column:
    """A fixed score for tests of decisions: the mean of three features."""
    return F.round((F.col("name_tok_jac").cast("double") + F.col("addr_tok_cont").cast("double") + F.col("addr_3gram_jac").cast("double")) / 3, 5)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "scored", lambda: some_features(spark, sf_dir).select("s1_id", "cand_id", "country", probability().alias("prob")))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).filter("prob >= 0.625")
    q = sides(spark, sf_dir)[0].select(F.col("entity_id").alias("s1_id"))
    return decide.result_lists(q, decide.one_to_one(s))
