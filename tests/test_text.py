"""Normalisation by rule, hash buckets and string similarities."""

import hashlib

import pytest
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as T

#: One case a rule: case, signs, blanks, marks, letters with a mark each, Indic letters, nothing left, numbers, hyphens, underscores.
GOLDEN = [
    ("GreenLeaf's BAKERY!", "greenleaf s bakery"), ("N.O.R.D. + Sons; G.m.b.H.", "n o r d sons g m b h"), (" \tTwin   Rivers\n", "twin rivers"), ("Señor Müller à Gdańsk", "senor muller a gdansk"), ("Žižek Ő Şirket Āć", "zizek o sirket ac"),
    ("Cafe\u0301s", "cafes"), ("दिल्ली Mills", "द ल ल mills"), ("???", ""), ("", ""), ("77 Elm St., Unit #4", "77 elm st unit 4"), ("Jean-Luc", "jean luc"), ("snake_case", "snake_case"),
]


@pytest.mark.parametrize("unicode", [True, False])
def test_golden_and_idempotent(spark, unicode):
    d = spark.createDataFrame(GOLDEN, "a string, b string").withColumn("n", T.norm_blocking(F.col("a"), unicode=unicode))
    d = d.withColumn("again", T.norm_blocking(F.col("n"), unicode=unicode))
    for r in d.collect():
        assert r["n"] == r["b"] == r["again"]


def test_hash_buckets(spark):
    ids = [f"S1-{k}" for k in (965667, 1, 2, 77)]
    rows = spark.createDataFrame([(i,) for i in ids], "i string").select("i", T.shard_of(F.col("i"), 3).alias("s"), T.validation_bucket(F.col("i")).alias("b")).collect()
    for r in rows:
        n = int(hashlib.md5(r["i"].encode()).hexdigest(), 16)
        assert (r["s"], r["b"]) == (n % 3, n // 1000 % 100)
    assert (rows[0]["s"], rows[0]["b"]) == (0, 98)


def test_scalar_spot_values(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    e = F.expr("cast(array() as array<string>)")
    r = spark.range(1).select(
        S.best_digit_similarity(a("4804"), a("2804")).alias("lev"), S.digit_prefix(a("3859"), a("385")).alias("pre"), S.jaccard(e, e).alias("j"), S.containment(a("x"), e).alias("c"), S.levenshtein_similarity(F.lit(""), F.lit("")).alias("l"),
        T.jaro_winkler(F.lit("martha"), F.lit("marhta")).alias("jw"), T.jaro_winkler(F.lit(""), F.lit("")).alias("jw0"), T.norm_feature(F.lit("Crème  Brûlée №5")).alias("nf"), T.char_grams(F.lit("ab")).alias("g2"), T.char_grams(F.lit("ab cd")).alias("g4"), T.collapse_repeats(F.lit("aabbc")).alias("cr"),
    ).head()
    assert (r["lev"], r["pre"], r["j"], r["c"], r["l"], r["jw0"]) == (0.75, 1.0, 0.0, 0.0, 1.0, 1.0)
    assert abs(r["jw"] - 0.9611) < 1e-4 and r["nf"] == "creme brulee o5" and r["g2"] == ["ab"] and r["g4"] == ["abc", "bcd"] and r["cr"] == "abc"
