"""Licence scan by a positional rare-token index. DataFrame functions only.

Of each template its highest-IDF words are posted as (word, template, position), as many as any start
that holds must have one of in place: those left out weigh less than MIN_COVER together. A document is
looked up for every template whose key phrases' words it has, every hit votes for a start (its place
less the posting's position), the words around each start are weighed by IDF, and the template's
mandatory key phrases must stand there. No start that holds is lost. IDF is counted over all documents. Everything but that count is local to a document, so only
the vocabulary's counts (one row a licence word and task) are shuffled.

Defined cases: null and empty texts have no words and no labels; texts of any length are scanned whole;
several labels of one place all count, and of several starts of one template the best is the score;
repeated rows give repeated rows; of other columns only ``doc_id`` and ``text`` are read, so clashing names do no harm; an empty table
gives an empty table.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are always reported, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, notice, and the phrases of it that must stand near their place in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "this software and associated documentation")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "with or without modification")),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("copy modify and or distribute this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Words too common to index; they still count when a start is weighed.
COMMON_WORDS = frozenset("a and any are by copy file files for forms free in into is may not of or permitted person purpose this to use with without you the 0 2 3 4 v".split())

MIN_COVER = 0.7  # share of a template's IDF that must stand at a start
SLACK = 2  # words by which a key phrase may have moved


def vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} - COMMON_WORDS)


def _words(text: Column) -> Column:
    """Words of the whole text in order; a split at the gaps leaves empty strings at the ends only."""
    low = F.translate(text, C.UPPER, C.UPPER.lower())
    return C.let(F.split(low, NOT_WORD), lambda w: F.when((w[0] == "") | (w[F.size(w) - 1] == ""), F.filter(w, lambda x: x != "")).otherwise(w))


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    """Do the phrase's words stand from ``at`` on?"""
    same = F.lit(True)
    for k, word in enumerate(phrase):
        same = same & F.coalesce(F.get(words, at + k) == word, F.lit(False))
    return same


def _places(words: Column, phrase: str, label: str) -> Column:
    p = phrase.split()
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(p)), lambda i: _stands(words, i, p))
    places = F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.alias("at")))
    some = (F.size(words) >= len(p)) & F.array_contains(words, p[0]) & F.array_contains(words, p[-1])
    return F.when(some, places).otherwise(F.expr("cast(array() as array<struct<label:string,at:int>>)"))


def _base_places(words: Column) -> Column:
    return F.concat(*[_places(words, phrase, label) for phrase, label in BASE])


SHAPE = "array<struct<label:string,terms:array<string>,weights:array<double>,keys:array<struct<off:int,terms:array<string>>>>>"


def _templates(weight) -> Column:
    """The templates as one constant; ``from_json`` of a constant is folded before the query runs."""
    rows = []
    for label, notice, phrases in TEMPLATES:
        terms = notice.split()
        total = sum(map(weight, terms))
        place = lambda p: next(i for i in range(len(terms)) if terms[i : i + len(p)] == p)  # noqa: B023, E731
        rows.append({"label": label, "terms": terms, "weights": [weight(w) / total for w in terms], "keys": [{"off": place(p.split()), "terms": p.split()} for p in phrases]})
    return F.from_json(F.lit(json.dumps(rows)), SHAPE)


def probes(notice: str, weight) -> list[str]:
    """The notice's rarest words, as many as leave less than MIN_COVER of its weight to all others."""
    terms = notice.split()
    found, rest = [], 1.0
    for w in sorted(set(terms), key=lambda w: (-weight(w), w)):
        if rest < MIN_COVER - 1e-9:
            break
        found.append(w)
        rest -= terms.count(w) * weight(w) / sum(map(weight, terms))
    return found


def _lookups(weight) -> Column:
    """Of each template its number, the indexed words that its key phrases need, and its probes."""
    rows = [{"t": t, "need": sorted({w for p in phrases for w in p.split()} - COMMON_WORDS), "probes": probes(notice, weight)} for t, (_, notice, phrases) in enumerate(TEMPLATES)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<t:int,need:array<string>,probes:array<string>>>")


def _postings(weight) -> Column:
    posted: dict[str, list[dict]] = {}
    for t, (_, notice, _) in enumerate(TEMPLATES):
        some = probes(notice, weight)
        for off, w in enumerate(notice.split()):
            if w in some:
                posted.setdefault(w, []).append({"t": t, "o": off})
    return F.from_json(F.lit(json.dumps(posted)), "map<string,array<struct<t:int,o:int>>>")


def _matches(words: Column, seen: Column, idf: dict[str, float]) -> Column:
    """Array of (label, score) of the starts that hold."""
    common = min(idf.values(), default=1.0) / 2  # of words that aren't indexed
    weight = lambda w: idf.get(w, common)
    templates, postings = _templates(weight), _postings(weight)
    live = F.filter(_lookups(weight), lambda x: F.forall(x["need"], lambda w: F.array_contains(seen, w)))

    def weighed(start: Column) -> Column:
        def of(t: Column) -> Column:
            cover = F.aggregate(F.transform(t["terms"], lambda w, k: F.when(F.get(words, start["d"] + k) == w, F.get(t["weights"], k)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
            stands = lambda at, p: F.forall(F.transform(p, lambda w, k: F.coalesce(F.get(words, at + k) == w, F.lit(False))), lambda x: x)
            sure = F.forall(t["keys"], lambda key: F.exists(F.array(*map(F.lit, range(-SLACK, SLACK + 1))), lambda move: stands(start["d"] + key["off"] + move, key["terms"])))
            return F.when((cover >= MIN_COVER) & sure, F.struct(t["label"].alias("label"), cover.alias("score")))

        return C.let(F.get(templates, start["t"]), of)

    def of(live: Column) -> Column:
        return C.let(F.array_distinct(F.flatten(live["probes"])), lambda rare: looked_up(live["t"], rare))

    def looked_up(tried: Column, rare: Column) -> Column:
        hits = F.filter(F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: F.array_contains(rare, h["w"]))
        posted = lambda h: F.filter(postings[h["w"]], lambda p: F.array_contains(tried, p["t"]))
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(posted(h), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["o"]).alias("d"))))))
        held = F.filter(F.transform(starts, weighed), lambda m: m.isNotNull())
        return F.when(F.size(tried) > 0, held).otherwise(F.expr("cast(array() as array<struct<label:string,score:double>>)"))

    return C.let(live, of)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``."""
    words = C.let(_words(C.text_of()), lambda w: C.let(F.array_intersect(_literal(vocabulary()), w), lambda seen: F.struct(
        F.size(w).cast("long").alias("n_words"), seen.alias("seen"), F.when(F.size(seen) > 0, w).alias("words"))))
    found = C.materialize(docs.select("doc_id", words.alias("s")).select("doc_id", "s.*"), "licence-words")
    df = found.select(F.explode("seen").alias("w")).groupBy("w").count()
    n, counts = found.count(), {r["w"]: r["count"] for r in df.collect()}  # one row a word of the templates
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1 for w in vocabulary()}
    judged = found.filter("words is not null").select("doc_id", "n_words", _base_places(F.col("words")).alias("base"), _matches(F.col("words"), F.col("seen"), idf).alias("more"))
    at = F.transform("base", lambda b: b["at"].cast("long"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base, more = F.transform("base", lambda b: b["label"]), F.transform("more", lambda m: m["label"])
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("more", lambda m: m["score"])), F.lit(0.0)))
    with_words = judged.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), labels(base).alias("base_labels"), labels(F.concat(base, more)).alias("labels"), F.least(score, F.lit(1.0)).alias("score"))
    without = found.filter("words is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return with_words.unionByName(without)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))
