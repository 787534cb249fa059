"""Checks of result files and of candidate tables. Each gives rows of (rule, offender), none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHING, CANDIDATES = "matched_entity_ids", "candidate_entity_ids"


def validate_lists(rows: DataFrame, column: str, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rules over (source1_entity_id, list). ``required`` and ``known`` have ``entity_id``."""
    s1 = F.col("source1_entity_id")
    ids = F.when(F.trim(column) != "", F.split(column, ",")).otherwise(F.expr("cast(array() as array<string>)"))
    d = rows.select(s1, ids.alias("ids"))
    each = d.select(F.explode(F.array_distinct("ids")).alias("id"))
    say = lambda f, rule, c: f.select(F.lit(rule).alias("rule"), c.alias("offender")).distinct()
    other = ~F.col("id").startswith("S2-") & ~F.col("id").startswith("S3-")
    out = say(d.groupBy("source1_entity_id").count().filter("count > 1"), "duplicate_row", s1)
    out = out.unionByName(say(d.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "repeated_id", s1))
    out = out.unionByName(say(each.filter(F.col("id").startswith("S1-")), "self_match", F.col("id")))
    out = out.unionByName(say(each.filter(other & ~F.col("id").startswith("S1-")), "wrong_prefix", F.col("id")))
    if known is not None:
        out = out.unionByName(say(each.filter(~other).join(known.select(F.col("entity_id").alias("id")), "id", "left_anti"), "unknown_id", F.col("id")))
    out = out.unionByName(say(required.join(d, F.col("entity_id") == s1, "left_anti"), "required_missing", F.col("entity_id")))
    return out.unionByName(say(d.join(required, F.col("entity_id") == s1, "left_anti"), "not_in_test", s1))


def validate_file(spark: SparkSession, path: str, column: str, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """As ``validate_lists`` for a tab-separated text, with the rules about the file itself."""
    shape = "rule string, offender string"
    try:
        lines = spark.read.text(path)
        first = lines.head()
    except Exception as e:  # a missing path is a finding
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([("file_not_found", path)], shape)
    if first is None:
        return spark.createDataFrame([("file_empty", path)], shape)
    header = first["value"]
    if "\t" not in header and "," in header:
        return spark.createDataFrame([("comma_separated", header)], shape)
    if [c.strip().lower() for c in header.split("\t")] != ["source1_entity_id", column]:
        return spark.createDataFrame([("wrong_header", header)], shape)
    body = spark.read.options(sep="\x01", header=True, quote="", escape="", enforceSchema=True).schema("value string").csv(path)
    no_tab = body.filter(~F.col("value").contains("\t") & (F.trim("value") != "")).select(F.lit("no_tab").alias("rule"), F.col("value").alias("offender"))
    rows = body.filter(F.col("value").contains("\t")).select(F.substring_index("value", "\t", 1).alias("source1_entity_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias(column))
    return no_tab.unionByName(validate_lists(rows, column, required, known))


def not_candidates(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warning: queries with matches that are not among their candidates. Both have (s1_id, cand_id)."""
    return matching.join(candidates, ["s1_id", "cand_id"], "left_anti").select(F.lit("match_not_candidate").alias("rule"), F.col("s1_id").alias("offender")).distinct()


def check_candidates(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Counts (rule, n) of broken invariants of a channel union and its index, and of its pairs."""
    flag = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    bit = lambda n: F.col("channels").bitwiseAND(n) > 0
    own = pairs.groupBy("s1_id", "cand_id").agg(F.count("*").alias("n"), F.min("channels").alias("channels"), F.max("word_rank").alias("word_rank"), F.max("char_rank").alias("char_rank"))
    c = own.agg(F.count("*").alias("pairs"), flag(F.col("n") > 1).alias("duplicate_pairs"), flag(F.col("channels") == 0).alias("no_channel"), flag(bit(1) != (F.col("word_rank") >= 0)).alias("word_bit"), flag(bit(2) != (F.col("char_rank") >= 0)).alias("char_bit"))
    i = index.join(pairs.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "full_outer").agg(flag(F.coalesce("n_cands", F.lit(-1)) != F.coalesce("n", F.lit(0))).alias("count_mismatch"))
    return c.unpivot([], c.columns, "rule", "n").unionByName(i.unpivot([], i.columns, "rule", "n"))


def merge_shards(shards: list[tuple[DataFrame, DataFrame]], manifests: list[dict] | None = None, allow_incomplete: bool = False) -> tuple[DataFrame, DataFrame]:
    """Union of the (pairs, index) of disjoint shards; raises if a query or pair is in two.

    With ``manifests`` it also raises where a shard isn't done, where settings differ, and, unless incomplete ones
    are allowed, where a shard is missing.
    """
    if manifests is not None:
        open_ones = [m.get("shard_id") for m in manifests if not m.get("done")]
        if open_ones:
            raise ValueError(f"not done: {open_ones}")
        settings = [{k: v for k, v in m.items() if k not in ("shard_id", "done")} for m in manifests]
        if any(x != settings[0] for x in settings):
            raise ValueError(f"settings differ: {settings}")
        missing = set(range(settings[0].get("num_shards", len(manifests)))) - {m.get("shard_id") for m in manifests}
        if missing and not allow_incomplete:
            raise ValueError(f"missing shards: {sorted(missing)}")
    pairs, index = shards[0]
    for p, i in shards[1:]:
        pairs, index = pairs.unionByName(p), index.unionByName(i)
    twice = index.groupBy("s1_id").count().filter("count > 1").select("s1_id").limit(5).collect()
    if twice:
        raise ValueError(f"in several shards: {[r['s1_id'] for r in twice]}")
    if not pairs.groupBy("s1_id", "cand_id").count().filter("count > 1").isEmpty():
        raise ValueError("repeated pairs")
    return pairs, index


def check_feature_order(columns: list[str], expected: list[str]) -> list[tuple[str, str]]:
    """(rule, column) for each column that a model expects and the table lacks, or has in another place."""
    missing = [("missing_feature", c) for c in expected if c not in columns]
    there = [c for c in columns if c in expected]
    return missing + [("out_of_order", c) for c, e in zip(there, [e for e in expected if e in columns], strict=True) if c != e]


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("s1_id", "cand_id").agg(F.count("*").alias("n")).filter("n > 1")


def in_several_parts(pairs: DataFrame, part: str = "part") -> DataFrame:
    """Queries whose pairs lie in more than one part of a written table."""
    return pairs.groupBy("s1_id").agg(F.countDistinct(part).alias("n_parts")).filter("n_parts > 1")


def not_finite(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n) of null, infinite and not-a-number values."""
    bad = lambda f: F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))
    s = rows.agg(*[F.coalesce(F.sum(bad(f).cast("long")), F.lit(0)).alias(f) for f in features])
    return s.unpivot([], s.columns, "feature", "n")
