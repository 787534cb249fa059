"""A training corpus from ``documents``: five stages, each over all rows that the one before kept."""

from __future__ import annotations

from linkloom.llm import common, decontaminate, mixing, pii, quality_rules, simhash


def rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go.

    Null and empty texts are rejected; texts of any length are read whole; a posterior at the bound keeps; repeated rows
    are judged alike; an empty table stays empty; other columns are handed through, whatever their names.
    """
    return quality_rules.filter_documents(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays.

    Null and empty texts are one group; texts of any length are compared whole; of a group the smallest id stays, null
    ids last, of equal ids the first row; of repeated rows one stays; an empty table stays empty; other columns are
    handed through, whatever their names.
    """
    return simhash.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; texts of any length are searched whole; an item held to just 0.8 counts;
    repeated rows are judged alike; with an empty table on either side nothing goes; other columns are handed through.
    """
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data in texts is replaced, and ``n_chars`` counted anew.

    Null texts stay null, empty ones empty; texts of any length are read whole; of overlapping spans the first names
    the replacement, ties by the order of kinds; repeated rows are changed alike; an empty table stays empty; other
    columns are handed through, whatever their names.
    """
    return pii.redact(docs)


def mix(spark, docs, sf_dir):
    """Documents are drawn by calibrated probabilities; adds ``mix_probability``, in place of one that was there.

    Null and empty texts have no tokens and take their cell's probability; null sources and languages are values;
    texts of any length are counted whole; ties in topics go to the first; repeated rows are drawn alike; an empty
    table stays empty; other columns are handed through, whatever their names.
    """
    return mixing.sample(docs)


STAGES = [("quality rules", rules), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("pii", personal_data), ("mixing", mix)]

#: Fingerprints, word statistics and learned models can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
