"""Command line: each command reads files that an earlier one wrote, so a run can be taken up at any step.

``python -m linkloom.cli candidates --s1 a.tsv --s2 b.tsv --s3 c.tsv --out dir`` and so on; ``-h`` lists the commands.
"""

from __future__ import annotations

import argparse
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import blocking, decide, features, learn, validate
from .sources import files


def _read(spark: SparkSession, a) -> DataFrame:
    rows = None
    for path in (a.s1, a.s2, a.s3):
        if path:
            one = files.read_tsv(spark, path)
            rows = one if rows is None else rows.unionByName(one)
    return rows


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    is_query = F.col("entity_id").startswith("S1-")
    return rows.filter(is_query), rows.filter(~is_query)


def _budgets(text: str) -> dict[str, tuple[int, int]]:
    """``US=50:50,India=100:80`` as word and char budgets of countries."""
    pairs = (part.split("=") for part in text.split(",") if part)
    return {country: tuple(int(n) for n in both.split(":")) for country, both in pairs}


def candidates(spark: SparkSession, a) -> None:
    """Pairs of the three channels within their budgets, the index of queries, and the manifest of the settings."""
    rows = _read(spark, a)
    rows = rows.withColumns({"nname": T.norm_blocking(F.col("business_name"), a.keep_marks), "naddr": T.norm_blocking(F.col("business_address"), a.keep_marks)})
    if a.countries:
        rows = rows.filter(F.col("country").isin(*a.countries.split(",")))
    queries, corpus = _split(rows)
    if a.s1_ids:
        queries = queries.join(files.read_ids(spark, a.s1_ids), "entity_id", "left_semi")
    queries = queries.filter(T.shard_of(F.col("entity_id"), a.num_shards) == a.shard_id)
    budgets, default = _budgets(a.budgets), _budgets("x=" + a.default_budget)["x"]
    most = [max([b[k] for b in budgets.values()] + [default[k]]) for k in (0, 1)]
    word = blocking.tfidf_topk(queries, corpus, most[0], threshold=a.threshold)
    char = blocking.tfidf_topk(queries, corpus, most[1], blocking.word_grams(F.concat("nname", F.lit(" "), "naddr")), a.threshold)
    pairs = blocking.budgeted(blocking.channel_union(word, char, blocking.exact_block(queries, corpus, cap=a.exact_cap)), budgets, default)
    files.write_parts(pairs, f"{a.out}/parts")
    blocking.query_index(queries, spark.read.parquet(f"{a.out}/parts")).write.mode("overwrite").parquet(f"{a.out}/index")
    files.write_manifest(spark, f"{a.out}/manifest", {"done": True, "shard_id": a.shard_id, "num_shards": a.num_shards, "budgets": a.budgets, "default_budget": a.default_budget, "exact_cap": a.exact_cap, "threshold": a.threshold, "keep_marks": a.keep_marks, "countries": a.countries})


def merge(spark: SparkSession, a) -> None:
    shards = [(spark.read.parquet(f"{p}/parts"), spark.read.parquet(f"{p}/index")) for p in a.shards]
    pairs, index = validate.merge_shards(shards, [files.read_manifest(spark, f"{p}/manifest") for p in a.shards], a.allow_incomplete)
    files.write_parts(pairs, f"{a.out}/parts")
    index.write.mode("overwrite").parquet(f"{a.out}/index")


def evaluate(spark: SparkSession, a) -> None:
    """Findings about the candidates and their recall."""
    pairs, index, truth = spark.read.parquet(f"{a.dir}/parts"), spark.read.parquet(f"{a.dir}/index"), files.read_ground_truth(spark, a.gt)
    hit = truth.join(pairs.select("s1_id", "cand_id", F.lit(1).alias("hit")), ["s1_id", "cand_id"], "left")
    recall = hit.agg(F.count("hit").alias("hits"), F.count("*").alias("links")).unpivot([], ["hits", "links"], "rule", "n")
    validate.check_candidates(pairs, index).unionByName(recall).coalesce(1).write.mode("overwrite").option("header", True).csv(a.report)


def featurize(spark: SparkSession, a) -> None:
    queries, corpus = _split(_read(spark, a))
    features.pair_features(spark.read.parquet(f"{a.cands}/parts"), queries, corpus, unicode=True).write.mode("overwrite").parquet(a.out)


def _labelled(spark: SparkSession, a) -> DataFrame:
    truth = files.read_ground_truth(spark, a.gt).withColumn("label", F.lit(1.0))
    rows = spark.read.parquet(a.features).join(truth, ["s1_id", "cand_id"], "left").na.fill(0.0, ["label"])
    return rows.withColumn("validates", T.validation_bucket(F.col("s1_id")) < a.val_pct)


def train(spark: SparkSession, a) -> None:
    learn.train_gbt(_labelled(spark, a).filter("not validates"), rounds=a.n_estimators, min_rows=a.min_rows).write().overwrite().save(a.model)


def validated(spark: SparkSession, a) -> None:
    """Precision, recall and macro F0.5 of the rows kept back, at each threshold."""
    scored = learn.predict(PipelineModel.load(a.model), _labelled(spark, a).filter("validates"))
    index = scored.select("s1_id", "country").distinct()
    truth = files.read_ground_truth(spark, a.gt).join(index, "s1_id", "left_semi")
    decide.sweep(index, scored, truth, [k / 20 for k in range(1, 20)]).coalesce(1).write.mode("overwrite").option("header", True).csv(a.report)


def predict(spark: SparkSession, a) -> None:
    """Both result files: matches one to one over the threshold, and all candidates."""
    scored = learn.predict(PipelineModel.load(a.model), spark.read.parquet(a.features))
    index = spark.read.parquet(f"{a.cands}/index")
    files.write_result(decide.result_lists(index, decide.one_to_one(scored.filter(F.col("prob") >= a.threshold))), f"{a.out}/matching_results")
    files.write_result(decide.result_lists(index, scored, "candidate_entity_ids"), f"{a.out}/candidate_pairs")


def check(spark: SparkSession, a) -> int:
    """Findings about the result files, printed; their number is the exit code."""
    required = files.read_ids(spark, a.ids) if a.ids else files.read_first_column(spark, a.s1)
    known = _split(_read(spark, a))[1].select("entity_id") if a.check_ids else None
    found = validate.validate_file(spark, a.matching, validate.MATCHING, required, known).unionByName(validate.validate_file(spark, a.candidate, validate.CANDIDATES, required, known))
    counts = {r["rule"]: r["count"] for r in found.groupBy("rule").count().collect()}
    print(json.dumps(counts, sort_keys=True))
    return min(len(counts), 100)


def shard_truth(spark: SparkSession, a) -> None:
    rows = files.read_tsv(spark, a.gt, "source1_entity_id string, matched_entity_ids string")
    files.write_shards(rows.withColumn("shard", T.shard_of(F.col("source1_entity_id"), a.num_shards)), a.out)


def profile(spark: SparkSession, a) -> None:
    rows = _read(spark, a).groupBy(F.substring("entity_id", 1, 2).alias("source"), "country")
    rows.agg(F.count("*").alias("n"), F.avg((F.col("business_address") == "").cast("int")).alias("no_address"), F.avg(T.is_indic(F.col("business_name")).cast("int")).alias("indic"), F.avg(F.length("business_name")).alias("mean_length")).coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkloom")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *options: str, **defaults) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for o in options:
            p.add_argument("--" + o, required=True)
        for o, value in defaults.items():
            flag = {"action": "store_true"} if value is False else {"default": value, "type": type(value) if value is not None else str}
            p.add_argument("--" + o.replace("_", "-"), **flag)
        p.set_defaults(run=run)
        return p

    command("profile", profile, "s1", "out", s2=None, s3=None)
    command("candidates", candidates, "s1", "s2", "s3", "out", budgets="US=50:50", default_budget="100:100", s1_ids=None, shard_id=0, num_shards=1, countries=None, exact_cap=200, threshold=0.05, keep_marks=False)
    command("merge", merge, "out", allow_incomplete=False).add_argument("--shards", nargs="+", required=True)
    command("evaluate", evaluate, "dir", "gt", "report")
    command("features", featurize, "s1", "s2", "s3", "cands", "out")
    command("train", train, "features", "gt", "model", val_pct=30, n_estimators=50, min_rows=60)
    command("validate", validated, "features", "gt", "model", "report", val_pct=30)
    command("predict", predict, "features", "cands", "model", "out", threshold=0.625)
    command("check", check, "matching", "candidate", "s1", s2=None, s3=None, ids=None, check_ids=False)
    command("shard-truth", shard_truth, "gt", "out", num_shards=3)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(SparkSession.builder.appName("linkloom").getOrCreate(), a) or 0


if __name__ == "__main__":
    raise SystemExit(main())
