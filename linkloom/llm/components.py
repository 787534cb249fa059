"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each half round lets every node point its neighbours at the least node it knows. The minimum of a
node's neighbours is aggregated before the shuffle and joined back to the edges, so a hub with a third
of all edges is a skewed side of a join, which adaptive execution splits, and never one task's group.
Rounds go on until the edges stay as they are; each is a Parquet table in the shared folder, which is
deleted once the next round is written whole, so two rounds are on disk at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("s")).head()
    return r["n"], r["x"], r["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.withColumnRenamed("m", "v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the least node of its component, for each node that has an edge to another.

    Nodes may be of any type that can be ordered. Null ends and loops are no edges; repeats are one.
    """
    one = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now = materialize(one, "edges")
    state = _state(now)
    while state[0]:
        now, last = materialize(_small_star(_large_star(now)), "edges"), now
        discard(last)
        state, before = _state(now), state
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
