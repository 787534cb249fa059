"""Text columns for record linkage. Built-in expressions, but for the few things that the engine lacks."""

from __future__ import annotations

import difflib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Words that say nothing in a business name.
NAME_STOP_WORDS = ("inc", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "co", "company", "llp", "sarl", "sas", "sci", "sa", "plc", "and", "the", "of", "com", "www", "pc")


def _strip(s: str) -> str:
    kept = (c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn" or ord(c) >= 0x900)
    return unicodedata.normalize("NFC", "".join(kept))


#: Letters that are one letter without their marks, by rule; and the marks that stand alone. Those from U+0900 on are letters' vowels.
ACCENTED = "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if unicodedata.decomposition(c) and len(_strip(c)) == 1 and _strip(c) != c)
PLAIN = "".join(map(_strip, ACCENTED))
MARKS = "".join(c for c in map(chr, range(0x80, 0x900)) if unicodedata.category(c) == "Mn")
INDIC = "[\\u0900-\\u0D7F]"
DOMAIN = r"(?i)\.(com|net|org|in)\b"


def fold_latin(c: Column) -> Column:
    """Lower case without accents, as ``strip_accents`` of it, but inside the JVM; plain ASCII is only lower-cased."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(F.lower(c), ACCENTED + MARKS, PLAIN))


@F.pandas_udf(StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    return texts.map(_strip, na_action="ignore")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_blocking(c: Column, keep_marks: bool = False, unicode: bool = False) -> Column:
    """Lower case, no accents, runs of anything but letters, digits and ``_`` as one blank."""
    folded = F.lower(strip_accents(c)) if unicode else fold_latin(c)
    if keep_marks:
        return _squeezed(F.regexp_replace(F.regexp_replace(folded, "[\\u0964\\u0965]", " "), "[^\\p{L}\\p{N}_\\s\\u0900-\\u0D7F]", " "))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


@F.pandas_udf(StringType())
def norm_feature(texts: pd.Series) -> pd.Series:
    """Lower case, compatibility decomposition without combining marks, letters a-z, digits and Indic letters."""
    other = re.compile("[^a-z0-9ऀ-ൿ ]+")

    def norm(s: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
        return " ".join(other.sub(" ", plain).split())

    return texts.map(norm, na_action="ignore")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def core_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(*NAME_STOP_WORDS))


def squash(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def digit_tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens(c), lambda t: t.rlike(r"^\p{Nd}+$"))))


def locality_tokens(c: Column) -> Column:
    words = F.filter(tokens(c), lambda t: t.rlike(r"^\p{L}+$"))
    return F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3)


def char_grams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams without blanks; a shorter text is one gram, an empty one none."""
    s = F.regexp_replace(c, " ", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(F.length(s) == 0, F.expr("cast(array() as array<string>)")).when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(grams))


def is_indic(c: Column) -> Column:
    return c.rlike(INDIC)


def pincode(c: Column, country: Column) -> Column:
    found = F.filter(tokens(c), lambda t: F.when(country == "India", t.rlike("^[0-9]{6}$")).otherwise(t.rlike("^[0-9]{5}$")))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def acronym(c: Column) -> Column:
    return F.array_join(F.transform(core_tokens(c), lambda t: F.substring(t, 1, 1)), "")


def is_domain_name(c: Column) -> Column:
    return c.rlike(DOMAIN)


def collapse_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"(.)\1+", "$1")


@F.pandas_udf(StringType())
def transliterate(texts: pd.Series) -> pd.Series:
    """ASCII view from Unicode character names: an Indic letter gives its name's last word, a vowel sign its sound."""
    known: dict[str, str] = {}

    def one(c: str) -> str:
        if c not in known:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())
            name = unicodedata.name(c, "").split()
            known[c] = plain if plain or not name else {"LETTER": name[-1].lower(), "SIGN": name[-1].lower() if "VOWEL" in name else "", "DIGIT": str(unicodedata.digit(c, ""))}.get(next((w for w in name if w in ("LETTER", "SIGN", "DIGIT")), ""), "")
        return known[c]

    return texts.map(lambda s: s if s.isascii() else "".join(c if c.isascii() else one(c) for c in s), na_action="ignore")


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text, a row each, and lengths."""
    n = texts.str.len().to_numpy(np.int64)
    out = np.zeros((len(n), max(1, int(n.max(initial=0)))), np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


def jaro_winklers(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Jaro-Winkler of all pairs at once: one step for each place of the longest first text."""
    if not len(a):
        return np.empty(0)
    (x, n), (y, m) = _codes(a), _codes(b)
    rows, place = np.arange(len(n)), np.arange(y.shape[1])
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    free, took = place < m[:, None], np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        fits = free & (y == x[:, i, None]) & (np.abs(place - i) <= reach[:, None]) & (i < n)[:, None]
        first, some = fits.argmax(1), fits.any(1)
        free[rows[some], first[some]] = False
        took[:, i] = some
    used = (place < m[:, None]) & ~free
    k = took.sum(1)
    order = lambda c, u: c[rows[:, None], np.argsort(~u, 1, kind="stable")]
    width = min(x.shape[1], y.shape[1])
    swaps = ((order(x, took)[:, :width] != order(y, used)[:, :width]) & (np.arange(width) < k[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(k > 0, (k / n + k / m + (k - swaps) / k) / 3, 0.0)
    head = np.arange(min(4, width))
    prefix = np.logical_and.accumulate((x[:, head] == y[:, head]) & (head < np.minimum(n, m)[:, None]), 1).sum(1)
    return np.where((n == 0) & (m == 0), 1.0, np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro))


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.concatenate([jaro_winklers(a.iloc[k : k + 2048], b.iloc[k : k + 2048]) for k in range(0, len(a), 2048)] or [np.empty(0)]))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _md5_mod(c: Column, n: int) -> Column:
    """The 128-bit MD5 number modulo n, digit by digit."""
    digits = F.transform(F.filter(F.split(F.md5(c.cast("binary")), ""), lambda x: x != ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * 16 + d) % n)


def shard_of(c: Column, n: int) -> Column:
    return _md5_mod(c, n).cast("int")


def validation_bucket(c: Column) -> Column:
    """(MD5 number // 1000) mod 100."""
    return F.floor(_md5_mod(c, 100_000) / 1000).cast("int")
