"""Operators over pairs and entities, on small tables with nulls, ties, unknown records and empty sides."""

from pyspark.sql import functions as F

from linkloom.operators import tables

ENTITY = "entity_id string, src int, country string, nname string, naddr string"
LINK = "s1_id string, cand_id string, country string"


def entities(spark):
    rows = [("S1-1", 1, "en", "red door inn", "5 low road"), ("S1-2", 1, "de", "", ""), ("S2-1", 2, "en", "red door inn", ""), ("S3-1", 3, "de", "blue", "1 a"), ("S3-2", 3, "en", "red door inn", "5 low road")]
    return spark.createDataFrame(rows, ENTITY)


def links(spark, *pairs):
    return spark.createDataFrame([(a, b, "en") for a, b in pairs], LINK)


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_labels_hits_and_misses(spark):
    truth, found = links(spark, ("S1-1", "S2-1"), ("S1-1", "S3-2")), links(spark, ("S1-1", "S2-1"), ("S1-2", "S3-1"))
    assert rows(tables.labelled(found, truth), "cand_id", "label") == [("S2-1", 1), ("S3-1", 0)]
    assert rows(tables.hits(truth, found), "cand_id", "hit") == [("S2-1", 1), ("S3-2", 0)]
    assert rows(tables.misses(truth, found), "cand_id") == [("S3-2",)] and tables.misses(truth.limit(0), found).count() == 0
    assert rows(tables.entity_recall(tables.hits(truth, found)), "entity_recall", "n") == [(0.0, 1)]
    assert rows(tables.sliced_recall(tables.hits(truth, found), entities(spark)), "slice", "value", "n", "recall") == [("ascii", "ascii", 2, 0.5), ("country", "en", 2, 0.5), ("source", "S2", 1, 1.0), ("source", "S3", 1, 0.0)]
    assert rows(tables.miss_categories(links(spark, ("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-1", "S3-2")), entities(spark)), "category", "misses") == [("common_words", 1), ("empty_address", 1), ("other_name", 1)]


def test_scores(spark):
    scored = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.9, 0), ("b", "x", 0.1, 1), ("b", "z", 1.0, 0)], "s1_id string, cand_id string, prob double, label int")
    assert rows(tables.confusion(scored, 0.9), "tp", "fp", "fn") == [(1, 2, 1)] and rows(tables.confusion(scored.limit(0), 0.9), "tp", "fp", "fn") == [(0, 0, 0)]
    assert rows(tables.score_bins(scored), "bin", "n", "actual") == [(1, 1, 1.0), (9, 2, 0.5), (10, 1, 0.0)]
    assert rows(tables.ranked(scored, "s1_id", F.desc("prob"), F.col("cand_id"), k=1), "s1_id", "cand_id") == [("a", "x"), ("b", "z")]
    assert rows(tables.running_sum(scored, "s1_id", "label", F.desc("prob"), F.col("cand_id")), "s1_id", "running") == [("a", 1), ("a", 1), ("b", 0), ("b", 1)]
    assert rows(tables.group_size(scored, "s1_id", "n"), "cand_id", "n") == [("x", 2), ("x", 2), ("y", 2), ("z", 2)]


def test_keys_of_entities(spark):
    e, truth = entities(spark), links(spark, ("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", "S3-1"))
    assert rows(tables.key_study(truth, e), "method", "n_true", "hits") == [("addr", 3, 1), ("addr_country", 3, 1), ("name", 3, 2), ("name_country", 3, 2)]
    assert rows(tables.key_study(truth.limit(0), e), "method", "hits") == [("addr", 0), ("addr_country", 0), ("name", 0), ("name_country", 0)]
    per = tables.links_of_entities(e, truth.filter("s1_id = 'S1-1'"))
    assert rows(per, "entity_id", "n", "s2", "s3") == [("S1-1", 2, 1, 1), ("S1-2", 0, 0, 0)]
    assert rows(tables.link_shapes(per), "entities", "none", "several", "both_sources") == [(2, 1, 1, 1)]
    assert rows(tables.with_attributes(links(spark, ("S1-1", "S9-9")), e), "s1_name", "cand_name") == [("red door inn", None)]
    cores = e.select("entity_id", F.col("nname").alias("core"))
    assert rows(tables.frequency_buckets(tables.labelled(truth, truth.limit(0)), cores), "bucket", "pairs", "matched") == [("1", 2, 0.0)]


def test_sets_with_null_keys(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (1,), (None,)], "j int")
    assert [r["k"] for r in tables.of_keys(a, "k", b, "j").collect()] == [1, 1]
    assert sorted(str(r["k"]) for r in tables.of_keys(a, "k", b, "j", held=False).collect()) == ["2", "None"]
    assert sorted((str(r["k"]), r["n"]) for r in tables.zero_filled_counts(a.distinct(), b, "k", "j").collect()) == [("1", 2), ("2", 0), ("None", 0)]
