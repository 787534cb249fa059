r"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is in a document when the document holds at least 0.8 of the item's distinct five-word
shingles. Words are runs of letters and digits (bytes above ASCII count as letters), ASCII lower-cased;
an item of fewer words is one shingle.

Containment of a short set in a long one is searched with MinHash sketches of the short side only, since
a document's own minima hold next to nothing of a short item. Items are partitioned by the power of two
of their number m of shingles; a partition asks for ``hits_of`` hits, more for longer items. An item's
sketch is its floor(0.2 m) + hits smallest hashes: a document that holds 0.8 of the item misses at most
floor(0.2 m), so it has that many hits, and no item is lost however long the document is.

Items stay distributed. Their sketches set bits of a filter of fixed size (FILTER_BITS, whatever the
benchmark's size), the only thing that is broadcast; one pass over the documents leaves each document's
hashes that are in it, and those few are joined with the sketches by equality. Documents and items with
enough hits are verified by exact shingle containment, on words rather than hashes.

Defined cases: null and empty texts hold nothing; items without words are in no document; texts of any
length are read whole, a batch of 4 MiB or one text at a time; repeated rows give repeated rows; ties do
not arise; with an empty table on either side nothing is found; columns beside ``doc_id``, ``text`` and
``item_id`` are not read, and ``remove`` hands them through untouched whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H

SHINGLE, SHARE = 5, 0.8
FILTER_BITS = 1 << 25
_WORDS = FILTER_BITS // 64
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ITEM = "struct<m:int,width:int,hits:int,sketch:array<long>>"


def needed(m: int, share: float = SHARE) -> int:
    """The fewest of ``m`` shingles that make the share."""
    return max(1, math.ceil(share * m - 1e-9))


def hits_of(m: int) -> int:
    """The hits that a partition of sizes asks for: 1 below 16 shingles, then one more with each power of two."""
    return max(1, m.bit_length() - 3)


def shingles(text: bytes, width: int = SHINGLE) -> set[tuple[bytes, ...]]:
    words = _WORD.findall(text.lower())
    width = min(width, len(words))
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if words else set()


def sketch(text: bytes, share: float = SHARE) -> tuple[int, int, int, list[int]]:
    """Number and width of an item's shingles, the hits that its partition asks for, and its smallest hashes."""
    own = shingles(text)
    if not own:
        return 0, 0, 0, []
    words, _ = H.word_hashes(np.frombuffer(text, np.uint8))
    width, m = len(next(iter(own))), len(own)
    hits = min(hits_of(m), needed(m, share))
    hashes = np.unique(H.shingle_hashes(words, width))[: m - needed(m, share) + hits]
    return m, width, hits, hashes.view(np.int64).tolist()


def _sketched(benchmark: DataFrame, share: float) -> DataFrame:
    """The items that have words, numbered, with their sketches, written once."""

    @F.pandas_udf(_ITEM)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(bytes(t), share) for t in texts], columns=["m", "width", "hits", "sketch"])

    text = C.text_of().cast("binary")
    rows = benchmark.select("item_id", text.alias("item_text"), of(text).alias("s"), F.monotonically_increasing_id().alias("item"))
    return C.materialize(rows.select("item_id", "item_text", "item", "s.*"), "items").filter("m > 0")


def _filter(items: DataFrame) -> np.ndarray:
    """A bit for each hash of a sketch: FILTER_BITS of them, gathered as at most _WORDS numbers."""
    h = items.select(F.explode("sketch").alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(_WORDS - 1).cast("int"), F.expr("shiftleft(1L, cast(h & 63 as int))")
    out = np.zeros(_WORDS, np.int64)
    for r in h.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r["w"]] = r["b"]
    return out.view(np.uint64)


def hits_in(column: pa.Array, bits: np.ndarray, widths: list[int]) -> pa.Array:
    """Of each text the distinct hashes of its shingles that are in the filter."""
    of, found = [], []
    for lo, hi, words, bounds in H.words_of(column):
        for width in widths:
            h = H.shingle_hashes(words, width)
            at = np.flatnonzero(bits[(h >> np.uint64(6)) & np.uint64(_WORDS - 1)] >> (h & np.uint64(63)) & np.uint64(1))
            doc = np.searchsorted(bounds, at, side="right") - 1
            inside = (doc < hi - lo) & (at + width <= bounds[np.minimum(doc + 1, hi - lo)])
            of.append(doc[inside] + lo)
            found.append(h[at[inside]].view(np.int64))
    doc = np.concatenate(of) if of else np.empty(0, np.int64)
    both = np.unique(np.stack([doc, np.concatenate(found) if found else doc], 1), axis=0)
    offsets = np.searchsorted(both[:, 0], np.arange(len(column) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(both[:, 1], pa.int64()))


def _hits(items: DataFrame, text: Column) -> Column:
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most SHINGLE of them
    shared = items.sparkSession.sparkContext.broadcast(_filter(items))

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        return hits_in(texts, shared.value, widths)

    return of(text)


def _held(suspects: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """``at``, ``item_id``, ``n_shared``, ``n_item`` of the items that rows (at, text, hits) hold."""
    posted = items.select("item", F.col("hits").alias("asked"), F.explode("sketch").alias("h"))
    met = suspects.select("at", F.explode("hits").alias("h")).join(posted, "h").groupBy("at", "item", "asked").count().filter("count >= asked").select("at", "item")

    @F.pandas_udf("long")
    def shared_with(texts: pd.Series, of: pd.Series) -> pd.Series:
        last, words, held, out = None, [], {}, []
        for t, item in zip(texts, of, strict=True):
            own = shingles(bytes(item))
            width = len(next(iter(own)))
            if t is not last and t != last:
                last, words, held = t, _WORD.findall(bytes(t).lower()), {}
            if width not in held:
                held[width] = set(zip(*(words[j:] for j in range(width)), strict=False))
            out.append(len(own & held[width]))
        return pd.Series(out, dtype="int64")

    pairs = met.join(items.select("item", "item_id", "item_text", F.col("m").cast("long").alias("n_item")), "item").join(suspects.select("at", F.col("text").cast("binary").alias("text")), "at")
    found = pairs.select("at", "item_id", shared_with("text", "item_text").alias("n_shared"), "n_item")
    return found.filter(F.col("n_shared") >= F.greatest(F.lit(1), F.ceil(share * F.col("n_item") - 1e-9)))


def find(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, ids: str = "doc_id") -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shared`` and ``n_item`` shingles and ``containment`` of each item that a document holds."""
    items = _sketched(benchmark, share)
    text = C.text_of()
    marked = docs.select(F.col(ids).alias("id"), text.alias("text"), _hits(items, text).alias("hits"), F.monotonically_increasing_id().alias("at"))
    suspects = C.materialize(marked.filter(F.size("hits") > 0), "suspects")
    found = _held(suspects, items, share).join(suspects.select("at", "id"), "at")
    return found.select(F.col("id").alias(ids), "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def remove(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns. Only rows with hits are joined."""
    items = _sketched(benchmark, share)
    text = C.text_of()
    marked = C.materialize(docs.select(F.struct("*").alias("row"), _hits(items, text).alias("hits"), F.monotonically_increasing_id().alias("at")), "marked")
    suspects = marked.filter(F.size("hits") > 0)
    held = _held(suspects.select("at", F.coalesce(F.col("row")["text"], F.lit("")).alias("text"), "hits"), items, share).select("at").distinct()
    return marked.filter(F.size("hits") == 0).select("row.*").unionByName(suspects.join(held, "at", "left_anti").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
