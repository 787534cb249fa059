"""Similarities of token sets and short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct arrays; 0 if either is empty. What is common is counted once, as no branch hides it."""
    both = F.size(F.array_intersect(a, b))
    return _share(both, F.size(a) + F.size(b) - both)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set; 0 if either is empty."""
    return _share(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def squash_containment(a: Column, b: Column) -> Column:
    """1 if the shorter of two squashed names, of over 6 letters, is in the longer."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return ((F.length(short) > 6) & long.contains(short)).cast("double")


def _capped(a: Column, size: int = 6) -> Column:
    return F.slice(a, 1, size)


def best_digit_similarity(a: Column, b: Column) -> Column:
    """Largest Levenshtein similarity of the first six digit tokens of each side; 0 without any."""
    return F.coalesce(F.array_max(F.flatten(F.transform(_capped(a), lambda x: F.transform(_capped(b), lambda y: levenshtein_similarity(x, y))))), F.lit(0.0))


def digit_prefix(a: Column, b: Column) -> Column:
    """1 if a digit token of at least two digits is a proper prefix of one of the other side."""
    cut = lambda t: F.substring(t, 1, 18)
    proper = lambda x, y: (F.length(x) >= 2) & (F.length(x) < F.length(y)) & y.startswith(x)
    return F.exists(_capped(a), lambda x: F.exists(_capped(b), lambda y: proper(cut(x), cut(y)) | proper(cut(y), cut(x)))).cast("double")
