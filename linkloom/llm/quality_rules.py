r"""Quality rules by weak supervision. DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote
patterns (at most 3 to the power of the number of rules, however many documents there are) estimates
how each rule votes on good and on bad documents; the posterior probability of good decides, not an
all-must-pass filter. The base rule (too few words, or too many in repeated windows) always rejects.

Windows are compared by 64-bit hashes of their words. A document is first tested on 4-word windows:
a repeated 8-word window makes at least five of them repeats, so most documents stop there.

Defined cases: null and empty texts have no words and fail the base rule; texts of any length are read
whole; a posterior of just KEEP_FROM and counts just at a rule's bound keep the document; repeated rows give repeated rows; an empty table gives an empty table; only ``doc_id``
and ``text`` are read, and ``filter_documents`` hands the other columns through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

GAP = rf"[{C.SPACE}]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Frequent function words of the four languages of the corpus.
FUNCTION_WORDS = "the of and to in a is that for it with was on are be as der die und den von zu das mit für ist ein eine le la les de des et en un une du est que pour el los las y del se por con".split()
RULES = ("length", "repetition", "symbols", "symbol_share", "lines", "word_size", "capitals", "function_words")
KEEP_FROM = 0.5
ROUNDS = 60


def _levels(h: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` (a power of two) words from hashes of the words."""
    if width == 1:
        return h
    step = width // 2
    return C.let(_levels(h, step), lambda o: F.zip_with(F.slice(o, 1, F.size(o) - step), F.slice(o, F.lit(step + 1), F.size(o) - step), lambda a, b: F.xxhash64(a, b)))


def _covered(hashes: Column) -> Column:
    """How many words stand in windows whose hash occurs twice or more."""
    def of(z: Column) -> Column:
        last = F.size(z) - 1
        same = lambda i, j: F.coalesce(F.get(z, i)["h"] == F.get(z, j)["h"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get(z, j)["i"]))
        return C.let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b))

    return C.let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)


def _repeat_words(words: Column) -> Column:
    none = F.lit(0).cast("long")
    repeats = lambda a: F.size(a) - F.size(F.array_distinct(a))

    def of(quads: Column) -> Column:
        octs = F.zip_with(F.slice(quads, 1, F.size(quads) - 4), F.slice(quads, F.lit(5), F.size(quads) - 4), lambda a, b: F.xxhash64(a, b))
        return F.when(repeats(quads) >= WINDOW - 3, C.let(octs, lambda o: F.when(repeats(o) > 0, _covered(o)).otherwise(none))).otherwise(none)

    return F.when(F.size(words) >= WINDOW, C.let(_levels(F.transform(words, lambda w: F.xxhash64(w)), 4), of)).otherwise(none)


def features(text: Column) -> Column:
    """A struct of counts over the whole text."""
    words = C.let(F.split(text, GAP), lambda w: F.when((w[0] == "") | (w[F.size(w) - 1] == ""), F.filter(w, lambda x: x != "")).otherwise(w))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{C.SPACE}]"))
    kept = lambda chars: F.length(F.regexp_replace(text, rf"[^{chars}]+", "")).cast("long")
    return C.let(words, lambda w: C.let(lines, lambda x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        kept("#*$%&|<>").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"),
        kept("A-Z").alias("n_capitals"),
        F.size(F.array_intersect(F.array(*map(F.lit, FUNCTION_WORDS)), w)).cast("long").alias("n_function"),
    )))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def votes(f: Column) -> Column:
    """A string with one of ``+-0`` for each of RULES.

    A rule votes only where it has evidence: most know what is bad, few know what is good.
    """
    n = f["n_words"]

    def vote(bad: Column, good: Column | None = None) -> Column:
        return F.when(bad, "-").when(F.lit(False) if good is None else good, "+").otherwise("0")

    return F.concat(
        vote(n < MIN_WORDS, n >= 2 * MIN_WORDS),
        vote(100 * f["n_repeat_words"] > 25 * n),
        vote(10 * f["n_symbols"] > n),
        vote(10 * f["n_symbols"] > f["word_chars"]),
        vote((f["n_dup_lines"] > 2) & (10 * f["n_dup_lines"] > 3 * f["n_lines"])),
        vote((2 * f["word_chars"] < 5 * n) | (f["word_chars"] > 15 * n)),
        vote(10 * f["n_capitals"] > 3 * f["word_chars"]),
        vote((f["n_function"] == 0) & (n >= MIN_WORDS), f["n_function"] > 1),
    )


def posterior(patterns: dict[str, int]) -> dict[str, float]:
    """Probability of good for each vote pattern, by expectation-maximisation from their counts.

    It starts from whether any rule votes bad, so that good stays the class which the rules call good.
    A rule's accuracies are its chances of voting good, bad or not at all on a document of either class.
    """
    good = {p: 0.02 if "-" in p else 0.98 for p in patterns}
    for _ in range(ROUNDS):
        total = sum(patterns.values()) or 1
        prior = (1 + sum(n * good[p] for p, n in patterns.items())) / (2 + total)
        seen = [[{v: 0.01 for v in "+-0"} for _ in RULES] for _ in range(2)]
        for p, n in patterns.items():
            for k, v in enumerate(p):
                seen[1][k][v] += n * good[p]
                seen[0][k][v] += n * (1 - good[p])
        chance = [[{v: math.log(x / sum(s.values())) for v, x in s.items()} for s in side] for side in seen]
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(chance[1][k][v] - chance[0][k][v] for k, v in enumerate(p))
            good[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return good


def _judged(counted: DataFrame) -> DataFrame:
    """Adds ``posterior`` to ``votes``; the table of patterns is bounded by the rules, not the documents."""
    patterns = {r["votes"]: r["count"] for r in counted.groupBy("votes").count().collect()}
    known = posterior(patterns)
    if not known:
        return counted.withColumn("posterior", F.lit(0.0))
    of = F.create_map(*[F.lit(x) for p, q in sorted(known.items()) for x in (p, q)])
    return counted.withColumn("posterior", of[F.col("votes")])


def judge(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``votes``, ``posterior`` and ``kept`` of each document."""
    f = docs.select("doc_id", features(C.text_of()).alias("f"))
    counted = C.materialize(f.select("doc_id", "f.*", base_failed(F.col("f")).alias("base_failed"), votes(F.col("f")).alias("votes")), "rule-votes")
    return _judged(counted).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def filter_documents(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    f = docs.select(F.struct("*").alias("row"), features(C.text_of()).alias("f"))
    counted = C.materialize(f.select("row", base_failed(F.col("f")).alias("base_failed"), votes(F.col("f")).alias("votes")), "rule-votes")
    return _judged(counted).filter(~F.col("base_failed") & (F.col("posterior") >= keep_from)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"))
