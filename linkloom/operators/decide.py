"""Decisions and metrics over scored pairs (s1_id, cand_id, prob)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_to_one(scored: DataFrame) -> DataFrame:
    """Each candidate goes to the query of its highest score; ties to the smallest query id."""
    order = W.partitionBy("cand_id").orderBy(F.desc("prob"), "s1_id")
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def f05(n_pred: Column, n_true: Column, tp: Column) -> Column:
    """1 if both sides are empty, 0 if one is or nothing is right."""
    p, r = tp / n_pred, tp / n_true
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when((n_pred == 0) | (n_true == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_counts(index: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``n_pred``, ``n_true``, ``tp`` of every query of the index, zeros included."""
    p = predicted.select("s1_id", "cand_id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("s1_id", "cand_id", F.lit(0).alias("p"), F.lit(1).alias("t")))
    per = p.groupBy("s1_id", "cand_id").agg(F.max("p").alias("p"), F.max("t").alias("t")).groupBy("s1_id").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"), F.sum(F.col("p") * F.col("t")).alias("tp"))
    return index.select("s1_id", "country").join(per, "s1_id", "left").na.fill(0, ["n_pred", "n_true", "tp"])


def macro_f05(index: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return entity_counts(index, predicted, truth).agg(F.count("*").alias("n"), F.round(F.avg(f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))), 6).alias("macro_f05"))


def sweep(index: DataFrame, scored: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """Precision, recall and macro F0.5 at each threshold: pairs are expanded by the grid, a constant."""
    labelled = scored.join(truth.select("s1_id", "cand_id", F.lit(1).alias("t")), ["s1_id", "cand_id"], "left").na.fill(0, ["t"])
    steps = F.explode(F.array(*map(F.lit, grid)))
    per = labelled.withColumn("threshold", steps).filter("prob >= threshold").groupBy("threshold", "s1_id").agg(F.count("*").alias("n_pred"), F.sum("t").alias("tp"))
    known = index.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").na.fill(0, ["n_true"]).withColumn("threshold", steps)
    j = known.join(per, ["threshold", "s1_id"], "left").na.fill(0, ["n_pred", "tp"])
    return j.groupBy("threshold").agg(F.round(F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1)), 6).alias("precision"), F.round(F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1)), 6).alias("recall"), F.round(F.avg(f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))), 6).alias("macro_f05"))


def expected_f05(scored: DataFrame) -> DataFrame:
    """For each query the prefix by score that has the largest expected F0.5; none if empty is better.

    ``exp(sum(log1p(-p)))`` is the chance that nothing is right; a sure pair makes it zero.
    """
    by = W.partitionBy("s1_id").orderBy(F.desc("prob"), "cand_id")
    whole = W.partitionBy("s1_id")
    p = F.col("prob")
    none = F.when(F.max((p >= 1).cast("int")).over(whole) > 0, 0.0).otherwise(F.exp(F.sum(F.log1p(-F.least(p, F.lit(1 - 1e-15)))).over(whole)))
    d = scored.withColumn("k", F.row_number().over(by)).withColumn("tp", F.sum(p).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("all", F.sum(p).over(whole)).withColumn("none", none)
    prec, rec = F.col("tp") / F.col("k"), F.col("tp") / F.greatest("all", F.lit(1e-9))
    d = d.withColumn("f", F.round(F.when(F.col("tp") > 0, 1.25 * prec * rec / (0.25 * prec + rec)).otherwise(0.0) * (1 - F.col("none")), 9))
    best = F.min(F.struct(-F.col("f"), "k")).over(whole)
    d = d.withColumn("best", best)
    return d.filter((F.col("f") > 0) & (-F.col("best.col1") > F.round("none", 9)) & (F.col("k") <= F.col("best.k"))).select("s1_id", "cand_id", "prob", "k")


STEPS = 1024


def score_counts(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """``pos`` and ``n`` of each score from 0 to 1, and of all smaller scores (``pos_below``, ``n_below``).

    Running sums in two levels, over STEPS ranges of scores and inside each, so no task sorts all scores.
    """
    by = scored.groupBy(score).agg(F.sum(label).cast("long").alias("pos"), F.count("*").alias("n")).withColumn("step", F.floor(F.col(score) * STEPS))
    below = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    steps = by.groupBy("step").agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    steps = steps.select("step", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_before") for c in ("p", "m")])
    inside = W.partitionBy("step").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    both = by.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("pos", "n")}).join(steps, "step")
    return both.select(score, "pos", "n", (F.col("p_before") + F.col("pos_inside")).alias("pos_below"), (F.col("m_before") + F.col("n_inside")).alias("n_below"))


def average_ranks(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """Each score's count and average rank, ascending from 1."""
    return score_counts(scored, label, score).select(score, "n", "pos", (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"))


def rank_auc(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """Area under the ROC curve from average ranks of equal scores."""
    s = average_ranks(scored, label, score).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return s.select(F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


def average_precision(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """Area under the precision-recall curve: each score's precision, weighed by the recall it adds."""
    c = score_counts(scored, label, score)
    all_of = c.agg(F.sum("pos").alias("p"), F.sum("n").alias("m"))
    each = c.join(F.broadcast(all_of))  # one row
    precision = (F.col("p") - F.col("pos_below")) / (F.col("m") - F.col("n_below"))
    return each.agg(F.round(F.sum(F.when(F.col("p") > 0, F.col("pos") / F.col("p") * precision).otherwise(0.0)), 6).alias("average_precision"))


def f05_stats(index: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts, precision, recall, macro F0.5, and the share of queries without a link that were left empty."""
    d = entity_counts(index, predicted, truth)
    s = d.agg(F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.avg(f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))).alias("f"),
              F.avg(F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("int"))).alias("single"))
    share = lambda n: F.round(F.col("tp") / F.greatest(F.col(n), F.lit(1)), 6)
    return s.select("n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), share("n_pred").alias("precision"), share("n_true").alias("recall"), F.round("f", 6).alias("macro_f05"), F.round("single", 6).alias("singleton_accuracy"))


def feature_signal(rows: DataFrame, features: list[str], label: str = "label", high: float = 0.9) -> DataFrame:
    """For each feature its AUC, its mean on either class, and precision and coverage where it is ``high``.

    Values are rounded to four decimals, so that equal ones are counted together before any sort.
    """
    long = rows.select(F.col(label).alias("label"), *[F.round(F.col(f).cast("double"), 4).alias(f) for f in features]).unpivot(["label"], features, "feature", "value")
    by = long.groupBy("feature", "value").agg(F.sum("label").cast("long").alias("pos"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("feature").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = F.col
    s = by.withColumn("rank", before + (c("n") + 1) / 2).groupBy("feature").agg(F.sum(c("rank") * c("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("m"), F.sum(c("value") * c("pos")).alias("vp"), F.sum(c("value") * c("n")).alias("v"),
        F.sum(F.when(c("value") >= high, c("pos"))).alias("hp"), F.sum(F.when(c("value") >= high, c("n"))).alias("hn"))
    q = lambda a, b: F.round(F.try_divide(a, b), 4)
    return s.select("feature", q(c("r") - c("p") * (c("p") + 1) / 2, c("p") * (c("m") - c("p"))).alias("auc"), q(c("vp"), c("p")).alias("pos_mean"), q(c("v") - c("vp"), c("m") - c("p")).alias("neg_mean"), q(c("hp"), c("hn")).alias("precision_high"), q(F.coalesce("hn", F.lit(0)), c("m")).alias("coverage_high"))


def compare(base: DataFrame, other: DataFrame, truth: DataFrame) -> DataFrame:
    """How many pairs the second prediction gains and loses against the first, right and wrong: (change, n)."""
    own = lambda d, b, o, t: d.select("s1_id", "cand_id", F.lit(b).alias("b"), F.lit(o).alias("o"), F.lit(t).alias("t"))
    each = own(base, 1, 0, 0).unionByName(own(other, 0, 1, 0)).unionByName(own(truth, 0, 0, 1)).groupBy("s1_id", "cand_id").agg(F.max("b").alias("b"), F.max("o").alias("o"), F.max("t").alias("t"))
    count = lambda e: F.coalesce(F.sum(F.expr(e).cast("int")), F.lit(0)).cast("long")
    s = each.agg(count("o = 1 and b = 0 and t = 0").alias("new_fp"), count("o = 0 and b = 1 and t = 0").alias("fixed_fp"), count("o = 1 and b = 0 and t = 1").alias("new_tp"), count("o = 0 and b = 1 and t = 1").alias("lost_tp"))
    return s.unpivot([], s.columns, "change", "n")


def result_lists(index: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """Every query once, its ids sorted and comma-joined, empty if it has none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(name))
    return index.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def outcomes(pairs: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``kind`` of each pair: TP, FP, FN or TN."""
    marks = lambda d, name: d.select("s1_id", "cand_id", F.lit(True).alias(name))
    j = pairs.join(marks(predicted, "_p"), ["s1_id", "cand_id"], "left").join(marks(truth, "_t"), ["s1_id", "cand_id"], "left").na.fill(False, ["_p", "_t"])
    kind = F.when(F.col("_p") & F.col("_t"), "TP").when(F.col("_p"), "FP").when(F.col("_t"), "FN").otherwise("TN")
    return j.withColumn("kind", kind).drop("_p", "_t")


def slices(index: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts and macro F0.5 of each country, and of each source on its own."""
    def measured(name: str, value: Column, p: DataFrame, t: DataFrame) -> DataFrame:
        d = entity_counts(index, p, t).groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"), F.sum("n_true").alias("n_true"), F.round(F.avg(f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))), 6).alias("macro_f05"))
        return d.select(F.lit(name).alias("slice"), "value", "n", "n_pred", "tp", "n_true", "macro_f05")

    out = measured("country", F.col("country"), predicted, truth)
    for source in ("S2", "S3"):
        own = F.col("cand_id").startswith(source + "-")
        out = out.unionByName(measured("source", F.lit(source), predicted.filter(own), truth.filter(own)))
    return out


def bounds(index: DataFrame, predicted: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Macro F0.5 as decided, and had there been no false positive, all reachable links found, or both."""
    pairs = lambda d: d.select("s1_id", "cand_id")
    right = pairs(predicted).join(pairs(truth), ["s1_id", "cand_id"], "left_semi")
    reachable = pairs(candidates).join(pairs(truth), ["s1_id", "cand_id"], "left_semi")
    out = None
    for world, p in (("as_decided", pairs(predicted)), ("no_false_positive", right), ("all_reachable", pairs(predicted).unionByName(reachable).distinct()), ("perfect_scores", reachable)):
        one = entity_counts(index, p, truth).agg(F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"), F.round(F.avg(f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))), 6).alias("macro_f05")).select(F.lit(world).alias("world"), "n_pred", "tp", "macro_f05")
        out = one if out is None else out.unionByName(one)
    return out


def _merged(x: tuple, y: tuple) -> tuple:
    """Number, means and sums of products of deviations of two parts' rows together."""
    n, d = x[0] + y[0], y[1] - x[1]
    return n, x[1] + d * (y[0] / n), x[2] + y[2] + np.outer(d, d) * (x[0] * y[0] / n)


def comoments(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each two of the columns, in their order, ``a``, ``b``, population covariance ``cov`` and deviations ``sa`` and ``sb``.

    One pass of matrix products in each task, merged in one: hundreds of aggregates in one plan take the engine longer
    to compile than to run.
    """
    k = len(names)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_of = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                mean = x.mean(0)
                part = batch.num_rows, mean, (x - mean).T @ (x - mean)
                all_of = part if all_of is None else _merged(all_of, part)
        if all_of is not None:
            yield pa.RecordBatch.from_pydict({"n": [all_of[0]], "mean": [all_of[1].tolist()], "products": [all_of[2].ravel().tolist()]})

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_of = None
        for row in (r for batch in batches for r in batch.to_pylist()):
            part = row["n"], np.array(row["mean"]), np.array(row["products"]).reshape(k, k)
            all_of = part if all_of is None else _merged(all_of, part)
        if all_of is not None:
            cov = all_of[2] / all_of[0]
            i, j = np.triu_indices(k, 1)
            sd = np.sqrt(np.diag(cov))
            yield pa.RecordBatch.from_pydict({"a": [names[x] for x in i], "b": [names[x] for x in j], "cov": cov[i, j], "sa": sd[i], "sb": sd[j]})

    parts = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(of_rows, "n long, mean array<double>, products array<double>")
    return parts.repartition(1).mapInArrow(of_parts, "a string, b string, cov double, sa double, sb double")


def correlated(rows: DataFrame, features: list[str], least: float = 0.8) -> DataFrame:
    """Pairs of features (a, b, corr) whose correlation is ``least`` or more, of either sign, all from one pass."""
    spread = F.nullif(F.round(F.col("sa") * F.col("sb"), 9), F.lit(0.0))  # constants have no correlation
    return comoments(rows, features).select("a", "b", F.round(F.col("cov") / spread, 3).alias("corr")).filter(F.abs("corr") >= least)


def delta(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of one side only, ``lost`` or ``gained``, and whether they are true."""
    pairs = lambda d: d.select("s1_id", "cand_id")
    lost, gained = before.join(after, ["s1_id", "cand_id"], "left_anti"), after.join(before, ["s1_id", "cand_id"], "left_anti")
    both = pairs(lost).withColumn("kind", F.lit("lost")).unionByName(pairs(gained).withColumn("kind", F.lit("gained")))
    return both.join(pairs(truth).withColumn("is_true", F.lit(True)), ["s1_id", "cand_id"], "left").na.fill(False, ["is_true"])


def shard_truth(index: DataFrame, truth: DataFrame, n: int) -> DataFrame:
    """Each shard's entities, links and entities without a link. Shards follow from ids, so they are disjoint and whole by rule."""
    from ..functions.text import shard_of

    links = truth.groupBy("s1_id").agg(F.count("*").alias("n"))
    each = index.select("s1_id").join(links, "s1_id", "left").na.fill(0, ["n"]).withColumn("shard", shard_of(F.col("s1_id"), n))
    return each.groupBy("shard").agg(F.count("*").alias("entities"), F.sum("n").alias("links"), F.count_if(F.col("n") == 0).alias("singletons"))


def truth_profile(index: DataFrame, truth: DataFrame) -> DataFrame:
    """How many entities have how many links, of which source, and how many candidates are linked more than once."""
    per = truth.groupBy("s1_id").agg(F.count("*").alias("n_links"), F.count_if(F.col("cand_id").startswith("S2-")).alias("s2"), F.count_if(F.col("cand_id").startswith("S3-")).alias("s3"))
    by = index.select("s1_id").join(per, "s1_id", "left").na.fill(0).groupBy("n_links").agg(F.count("*").alias("entities"), F.sum("s2").alias("in_s2"), F.sum("s3").alias("in_s3"))
    reused = truth.groupBy("cand_id").count().filter("count > 1").agg(F.count("*").alias("reused"))
    return by.join(F.broadcast(reused))  # one row


def chains(entities: DataFrame) -> DataFrame:
    """Of each country the quantiles of names' frequencies, the share of records in chains, and of names in several sources."""
    names = entities.filter("nname <> ''").groupBy("country", "nname").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"))
    return names.groupBy("country").agg(F.count("*").alias("names"), F.max("n").alias("most"), F.round(F.percentile("n", 0.5), 4).alias("median"), F.round(F.percentile("n", 0.99), 4).alias("p99"),
        F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share_in_chains"), F.round(F.avg((F.col("n_src") > 1).cast("int")), 6).alias("in_several_sources"))


def running_offsets(index: DataFrame) -> DataFrame:
    """``first_row`` of each query in its country, in two levels: sums of id ranges first, so no task sorts a country."""
    part = F.substring("s1_id", 1, 5)
    whole = index.groupBy("country", part.alias("part")).agg(F.sum("n_cands").alias("n"))
    before = whole.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("country").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("n_cands").over(W.partitionBy("country", "part").orderBy("s1_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return index.withColumn("part", part).withColumn("inside", inside).join(before, ["country", "part"]).select("s1_id", (F.col("before") + F.col("inside")).cast("long").alias("first_row"))


def study(found: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Of each ``method`` of ``found`` its pairs, the share of links among them, and candidates a query."""
    hit = truth.select("s1_id", "cand_id", F.lit(1).alias("hit"))
    all_of = truth.agg(F.count("*").alias("links")).join(F.broadcast(queries.agg(F.count("*").alias("asked"))))  # one row
    by = found.join(hit, ["s1_id", "cand_id"], "left").groupBy("method").agg(F.count("*").alias("pairs"), F.count("hit").alias("hits"))
    return by.join(F.broadcast(all_of)).select("method", "pairs", F.round(F.col("hits") / F.col("links"), 6).alias("recall"), F.round(F.col("pairs") / F.col("asked"), 6).alias("mean_candidates"))
