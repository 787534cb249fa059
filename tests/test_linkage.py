"""Decisions, files, validation, models and the registry against its SQL."""

import difflib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from linkloom import cli, registry
from linkloom.functions import text as T
from linkloom.operators import blocking, decide, features, validate
from linkloom.plans import entities as E
from linkloom.sources import files

SF = "/root/testdata/sf0.001"
#: Two queries want one candidate with equal scores, one loses all to another, one has none over the threshold, one none at all.
WORLD = [("S1-10", "S3-4", 0.7), ("S1-10", "S2-8", 0.64), ("S1-20", "S3-4", 0.7), ("S1-20", "S2-3", 0.99), ("S1-30", "S2-3", 0.8), ("S1-40", "S2-6", 0.3)]


@pytest.fixture
def world(spark):
    index = spark.createDataFrame([(f"S1-{k}", "FR") for k in (10, 20, 30, 40, 50)], "s1_id string, country string")
    return index, spark.createDataFrame(WORLD, "s1_id string, cand_id string, prob double")


def test_ties_losers_and_entities_without_candidates(world):
    index, scored = world
    chosen = decide.one_to_one(scored.filter("prob >= 0.625"))
    got = {r[0]: r[1] for r in decide.result_lists(index, chosen).collect()}
    assert got == {"S1-10": "S2-8,S3-4", "S1-20": "S2-3", "S1-30": "", "S1-40": "", "S1-50": ""}
    every = {r[0]: r[1] for r in decide.result_lists(index, scored).collect()}
    assert every["S1-40"] == "S2-6" and every["S1-50"] == ""


def test_macro_f05_counts_empty_entities(spark, world):
    index, _ = world
    pairs = lambda *p: spark.createDataFrame(list(p), "s1_id string, cand_id string")
    true = pairs(("S1-10", "S2-1"), ("S1-10", "S2-2"))
    r = decide.macro_f05(index, pairs(("S1-10", "S2-1"), ("S1-10", "S2-2"), ("S1-10", "S2-3"), ("S1-20", "S2-9")), true).head()
    assert r["n"] == 5 and abs(r["macro_f05"] - (0.714286 + 0 + 1 + 1 + 1) / 5) < 1e-5


def test_files_round_trip(spark, tmp_path, world):
    index, scored = world
    p = tmp_path / "s1.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-A\t"Q" Café\t\tUS\nS1-B\tx\ty\tUS\n')
    rows = files.read_tsv(spark, str(p)).orderBy("entity_id").collect()
    assert rows[0]["business_name"] == '"Q" Café' and rows[0]["business_address"] == ""
    files.write_result(decide.result_lists(index, scored), str(tmp_path / "out"))
    assert validate.validate_file(spark, str(tmp_path / "out"), "matched_entity_ids", index.selectExpr("s1_id as entity_id")).count() == 0
    links = files.read_ground_truth(spark, str(tmp_path / "out"))
    assert links.count() == len(WORLD)
    files.write_manifest(spark, str(tmp_path / "m"), {"k": 1})
    assert files.read_manifest(spark, str(tmp_path / "m")) == {"k": 1}


@pytest.mark.parametrize(("text", "rule"), [
    (None, "file_not_found"), ("", "file_empty"), ("a,b\n", "comma_separated"), ("x\ty\n", "wrong_header"),
    ("source1_entity_id\tmatched_entity_ids\nS1-A\t\nS1-A\t\n", "duplicate_row"), ("source1_entity_id\tmatched_entity_ids\nS1-A\tS2-1,S2-1\n", "repeated_id"), ("source1_entity_id\tmatched_entity_ids\nS1-A\tS1-9\n", "self_match"),
    ("source1_entity_id\tmatched_entity_ids\nS1-A\tX\n", "wrong_prefix"), ("source1_entity_id\tmatched_entity_ids\nS1-A\tS2-7\n", "unknown_id"), ("source1_entity_id\tmatched_entity_ids\n", "required_missing"),
    ("source1_entity_id\tmatched_entity_ids\nS1-A\t\nS1-Z\t\n", "not_in_test"), ("source1_entity_id\tmatched_entity_ids\nS1-A\t\nbroken\n", "no_tab"),
])
def test_validator_rules(spark, tmp_path, text, rule):
    p = tmp_path / "r.tsv"
    if text is not None:
        p.write_text(text)
    required, known = spark.createDataFrame([("S1-A",)], "entity_id string"), spark.createDataFrame([("S2-1",)], "entity_id string")
    assert {r["rule"] for r in validate.validate_file(spark, str(p), "matched_entity_ids", required, known).collect()} == {rule}


def test_block_cap_and_missing_record(spark):
    shape = "entity_id string, country string, nname string, naddr string"
    q = spark.createDataFrame([("S1-1", "US", "a", ""), ("S1-2", "US", "", "")], shape)
    c = spark.createDataFrame([(f"S2-{k}", "US", "a", "") for k in range(5)] + [("S2-9", "US", "", "")], shape)
    assert sorted(r["cand_id"] for r in blocking.exact_block(q, c, cap=3).collect()) == ["S2-0", "S2-1", "S2-2"]
    raw = lambda d: d.selectExpr("*", "nname as business_name", "naddr as business_address")
    with pytest.raises(Exception, match="unknown record"):
        features.pair_features(spark.createDataFrame([("S1-1", "S2-77")], "s1_id string, cand_id string"), raw(q), raw(c)).collect()


@pytest.mark.parametrize("name", ["join_exact_name_block", "join_tfidf_topk_word", "join_tfidf_topk_char", "join_full_outer_union", "rule_one_to_one", "shard_of", "prep_records", "agg_percentiles", "scan_tsv", "scan_tsv_quoted", "sink_atomic", "sink_csv_append", "copy_parts", "strip_latin_accents", "norm_feature", "norm_v2", "char_3grams", "split_tokens", "vectorize_tfidf", "metric_pr_auc", "check_cross_file_s1"])
def test_registry_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(map(str, d[columns].astype(object).map(lambda v: float(v) if isinstance(v, (int, float)) else v).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_block_cap_in_two_levels_and_hot_tokens(spark, monkeypatch):
    rows = spark.createDataFrame([(f"S2-{k:03}", "US", f"common word{k % 40}", "") for k in range(120)], "entity_id string, country string, nname string, naddr string")
    kept = blocking.first_of_key(rows.withColumn("key", F.lit("x")), ["key"], 7)
    assert sorted(r["entity_id"] for r in kept.collect()) == [f"S2-{k:03}" for k in range(7)]
    q = spark.createDataFrame([("S1-1", "US", "common word3", ""), ("S1-2", "US", "word5", "")], rows.schema)
    whole = sorted(map(tuple, blocking.tfidf_topk(q, rows, 2).collect()))
    monkeypatch.setattr(blocking, "POSTINGS", 1)
    assert sorted(map(tuple, blocking.tfidf_topk(q, rows, 2).collect())) == whole and len(whole) == 4


def test_merge_refuses_bad_shards(spark):
    shard = lambda k: (spark.createDataFrame([(f"S1-{k}", "S2-1")], "s1_id string, cand_id string"), spark.createDataFrame([(f"S1-{k}",)], "s1_id string"))
    m = lambda k, **how: {"shard_id": k, "num_shards": 2, "done": True, **how}
    assert validate.merge_shards([shard(0), shard(1)], [m(0), m(1)])[0].count() == 2
    for shards, manifests, why in (([shard(0), shard(1)], [m(0), m(1, done=False)], "not done"), ([shard(0), shard(1)], [m(0), m(1, cap=3)], "differ"), ([shard(0)], [m(0)], "missing"), ([shard(0), shard(0)], None, "several")):
        with pytest.raises(ValueError, match=why):
            validate.merge_shards(shards, manifests)
    assert validate.merge_shards([shard(0)], [m(0)], allow_incomplete=True)[1].count() == 1


def test_views_are_written_once_a_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 90").write.parquet(f"{tmp_path}/documents.parquet")
    first = E.entities(spark, str(tmp_path))
    assert E.entities(spark, str(tmp_path)).inputFiles() == first.inputFiles() and first.count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 30").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert E.entities(spark, str(tmp_path)).count() < first.count()


def test_command_line_from_files_to_a_valid_result(spark, tmp_path, capsys):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, truth = [], []
    for k in range(60):
        name, street = f"{word()} {word()}", f"{r.randint(1, 99)} {word()} road {word()}"
        rows.append((f"S1-{k}", name, street, "US"))
        if k % 3:
            rows.append((f"S2-{k}", name.upper(), street, "US"))
            rows.append((f"S3-{k}", name, "" if k % 5 == 0 else street + " north", "US"))
        truth.append((f"S1-{k}", f"S2-{k},S3-{k}" if k % 3 else ""))
    at = lambda name: str(tmp_path / name)
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for s in ("S1", "S2", "S3"):
        (tmp_path / f"{s}.tsv").write_text(head + "".join("\t".join(x) + "\n" for x in rows if x[0].startswith(s)))
    (tmp_path / "gt.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in truth))
    sources = ["--s1", at("S1.tsv"), "--s2", at("S2.tsv"), "--s3", at("S3.tsv")]
    run = lambda *args: cli.main([*args])
    for k in (0, 1):
        run("candidates", *sources, "--out", at(f"c{k}"), "--shard-id", str(k), "--num-shards", "2")
    run("merge", "--shards", at("c0"), at("c1"), "--out", at("c"))
    run("evaluate", "--dir", at("c"), "--gt", at("gt.tsv"), "--report", at("report"))
    found = {x["rule"]: int(x["n"]) for x in spark.read.option("header", True).csv(at("report")).collect()}
    assert found["hits"] == found["links"] == 80 and not any(found[x] for x in ("duplicate_pairs", "no_channel", "word_bit", "char_bit", "count_mismatch"))
    run("features", *sources, "--cands", at("c"), "--out", at("f"))
    run("train", "--features", at("f"), "--gt", at("gt.tsv"), "--model", at("m"), "--n-estimators", "3", "--min-rows", "2")
    run("validate", "--features", at("f"), "--gt", at("gt.tsv"), "--model", at("m"), "--report", at("v"))
    assert max(float(x["macro_f05"]) for x in spark.read.option("header", True).csv(at("v")).collect()) > 0.9
    run("predict", "--features", at("f"), "--cands", at("c"), "--model", at("m"), "--out", at("r"))
    files_of = ["--matching", at("r/matching_results"), "--candidate", at("r/candidate_pairs")]
    assert run("check", *files_of, *sources, "--check-ids") == 0 and capsys.readouterr().out.strip().endswith("{}")
    run("shard-truth", "--gt", at("gt.tsv"), "--out", at("s"))
    assert spark.read.options(sep="\t", header=True).csv(at("s")).count() == 60
    run("profile", *sources, "--out", at("p"))
    assert spark.read.option("header", True).csv(at("p")).count() == 3


def test_ranks_and_average_precision_against_brute_force(spark):
    r = random.Random(3)
    rows = [(round(r.random(), 1 + k % 2), int(r.random() < 0.3)) for k in range(300)] + [(1.0, 1), (0.0, 0), (1.0, 0)]
    d = spark.createDataFrame(rows, "prob double, label int")
    order = sorted(p for p, _ in rows)
    ranks = {p: sum(k + 1 for k, q in enumerate(order) if q == p) / order.count(p) for p in set(order)}
    assert {x["prob"]: x["rank"] for x in decide.average_ranks(d).collect()} == ranks
    pos = [p for p, y in rows if y]
    neg = [p for p, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(decide.rank_auc(d).head()["auc"] - auc) < 1e-6
    ap = sum(pos.count(t) / len(pos) * sum(p >= t for p in pos) / sum(p >= t for p, _ in rows) for t in set(order))
    assert abs(decide.average_precision(d).head()["average_precision"] - ap) < 1e-6
    signal = decide.feature_signal(d, ["prob"]).head()
    assert abs(signal["auc"] - auc) < 1e-4 and abs(signal["pos_mean"] - sum(pos) / len(pos)) < 1e-4


def test_scores_without_rows_or_positives(spark):
    none = spark.createDataFrame([], "prob double, label int")
    assert decide.average_ranks(none).count() == 0 and decide.average_precision(none).head()[0] is None
    assert decide.average_precision(spark.createDataFrame([(0.5, 0)], "prob double, label int")).head()[0] == 0.0


def test_compare_and_checks(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "s1_id string, cand_id string")
    got = decide.compare(pairs(("a", "1"), ("a", "2"), ("b", "1")), pairs(("a", "1"), ("c", "3"), ("c", "4")), pairs(("a", "1"), ("a", "2"), ("c", "4")))
    assert {r["change"]: r["n"] for r in got.collect()} == {"new_fp": 1, "fixed_fp": 1, "new_tp": 1, "lost_tp": 1}
    assert [tuple(r) for r in validate.duplicate_pairs(pairs(("a", "1"), ("a", "1"), ("a", "2"))).collect()] == [("a", "1", 2)]
    odd = spark.createDataFrame([(1.0, float("nan")), (float("inf"), 2.0), (None, 3.0)], "x double, y double")
    assert {r["feature"]: r["n"] for r in validate.not_finite(odd, ["x", "y"]).collect()} == {"x": 2, "y": 1}
    assert validate.check_feature_order(["b", "z", "a"], ["a", "b", "c"]) == [("missing_feature", "c"), ("out_of_order", "b"), ("out_of_order", "a")]


def test_quotes_and_first_column(spark, tmp_path):
    p = tmp_path / "q.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-B\t"a ""b"" c"\t\tUS\nS1-A\tx"y\t9\tUS\n')
    assert {r["entity_id"]: r["business_name"] for r in files.read_quoted_tsv(spark, str(p)).collect()} == {"S1-A": 'x"y', "S1-B": 'a "b" c'}
    assert [r["entity_id"] for r in files.read_first_rows(spark, str(p), 1).collect()] == ["S1-A"]
    p.write_text("h\tx\nS1-A\t1\n\nS1-A\t2\nS1-B\n")
    assert {r["entity_id"] for r in files.read_first_column(spark, str(p)).collect()} == {"S1-A", "S1-B"}


def test_python_text_functions(spark):
    d = spark.createDataFrame([("Rama", "rama"), ("राम", "राम"), ("aab", "")], "a string, b string")
    rows = d.select("a", T.transliterate(F.col("a")).alias("t"), T.collapse_repeats(T.transliterate(F.col("a"))).alias("c"), T.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r, (a, b) in zip(rows, [("Rama", "rama"), ("राम", "राम"), ("aab", "")], strict=True):
        assert r["t"].isascii() and r["r"] == difflib.SequenceMatcher(None, a, b).ratio()
    assert rows[0]["t"] == "Rama" and rows[2]["c"] == "ab"


def test_products_of_blocks_agree_with_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary, idf = rng.permutation(np.arange(100, 160)), rng.uniform(1, 5, 60)
    texts = lambda n: pa.chunked_array([pa.array([list(rng.choice(np.arange(95, 160), rng.integers(0, 12), p=np.r_[np.full(10, 0.05), np.full(55, 0.5 / 55)])) for _ in range(n)], pa.list_(pa.int64()))])
    q, c = texts(40), texts(300)
    weight = dict(zip(vocabulary.tolist(), idf, strict=True))

    def unit(terms):
        w = {t: terms.count(t) * weight[t] for t in terms if t in weight}
        length = sum(x * x for x in w.values()) ** 0.5
        return {t: x / length for t, x in w.items()}

    held = [unit(t) for t in c.to_pylist()]
    want = []
    for i, own in enumerate(map(unit, q.to_pylist())):
        s = [(-round(sum(w * h.get(t, 0) for t, w in own.items()), 6), j) for j, h in enumerate(held)]
        want += [(i, j, -x) for x, j in sorted(s)[:7] if -x > 0.05]
    for dense in (0.0, 0.004, 1.0):
        monkeypatch.setattr(blocking, "DENSE", dense)
        assert list(zip(*map(np.ndarray.tolist, blocking.best_of_block(vocabulary, idf, q, c, 7, 0.05)), strict=True)) == want


def test_channels_make_no_row_for_each_pair_that_shares_a_term(spark):
    rows = spark.createDataFrame([("S1-1", "US", "a b", "")], "entity_id string, country string, nname string, naddr string")
    plan = blocking.tfidf_topk(rows, rows, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[s1_id#\d+, cand_id#\d+\]", plan)


def test_decisions_read_only_the_features_they_need(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 90").write.parquet(f"{tmp_path}/documents.parquet")
    name = lambda x: [k[1] for k in E._WRITTEN if k[2] == str(tmp_path) and k[1] == x]
    for query in ("agg_corr_matrix", "agg_group_means", "agg_quadrants", "agg_join_list", "agg_segment_max", "agg_bins", "agg_confusion", "agg_macro_f05", "agg_freq_bucket"):
        assert registry.QUERIES[query](spark, str(tmp_path)).count() > 0
    assert name("scored") and not name("features")


def test_channels_deal_their_blocks_to_many_tasks(spark):
    """Blocks are small in bytes and long in work: the engine, left alone, joins them into one task."""
    rows = spark.range(40).selectExpr("concat('S1-', id) AS entity_id", "'US' AS country", "concat('a b c', id % 7) AS nname", "'' AS naddr")
    found = blocking.tfidf_topk(rows, rows, 2)
    found.collect()
    assert "REPARTITION_BY_NUM, [plan_id" in found._jdf.queryExecution().executedPlan().toString()


def test_frequent_terms_are_summed_densely(monkeypatch):
    """Postings cost far more a hit than a dense product: few hits of a pair may be left to them."""
    rng, hits, runs = np.random.default_rng(3), [], blocking._runs
    monkeypatch.setattr(blocking, "_runs", lambda at, sizes: hits.append(int(sizes.sum())) or runs(at, sizes))
    rows = pa.chunked_array([pa.array([rng.choice(600, 20, replace=False) for _ in range(800)], pa.list_(pa.int64()))])
    blocking.best_of_block(np.arange(600), np.full(600, 2.0), rows, rows, 1, 0.9)
    assert hits[0] < 0.05 * len(rows) ** 2


def test_correlations_come_from_one_pass(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, 300)
    table = np.column_stack([x, x * -2 + rng.normal(0, 0.5, 300), rng.normal(0, 1, 300), np.full(300, 4.0)])
    rows = spark.createDataFrame(table.tolist(), "a double, b double, c double, d double").repartition(5)
    got = decide.correlated(rows, ["a", "b", "c", "d"])
    assert [(r.a, r.b, r["corr"]) for r in got.collect()] == [("a", "b", round(float(np.corrcoef(table[:, 0], table[:, 1])[0, 1]), 3))]
    assert "covar_pop" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert decide.correlated(rows.filter("a > 1e9"), ["a", "b"]).count() == 0
