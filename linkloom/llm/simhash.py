"""Near-duplicates through deletion-variant signatures.

A signature is cut into few enough segments that near signatures have one segment which differs in at
most one place. Each segment is indexed under its one-wildcard variants (that place deleted); texts that
meet under a variant are verified.

``components`` (the query) works on SimHash fingerprints, the bitwise majority of the XXH64 hashes of a
text's three-word shingles: 64 bits in two segments of 32, near at two differing bits. Exact copies are
one fingerprint from the start. Fingerprints that meet under any variant are linked through the 65 values
within one bit of each: two fingerprints share such a centre exactly when they are within two bits, at
most 65 fingerprints can share one, and each links to the least. This verifies all links in linear work
however full a variant is; none is lost.

``keep_one`` (the pipeline's stage) takes texts with a Jaccard similarity of SIMILARITY or more of their
distinct five-word shingles. Bits can't carry that: at 0.8 about nine of 64 differ, so segments with one
differing bit would be seven bits long and hold everything. So its signature has PLACES min-hashes in
place of bits, in segments of SEGMENT_PLACES of which one may differ: of two texts at 0.8 a segment agrees
so far with chance 0.66, one of four with 0.985, at 0.9 with 0.9998. Of the texts that meet under a
variant the one that meets most others stands for them and is compared with each by their words; each
text that is unlike any of these is also compared, under each of its variants, with one drawn from all who
meet there and one from those who meet most. So a text has at most three partners a variant, and work is
linear however many meet. What that leaves, where texts meet under no variant or are unlike all of their
partners and yet like another, an exact join finds among texts of different groups (``_missed``): alike texts
share one of the first fifth of their shingles in any order common to all. No link between groups is lost.

Defined cases: null and empty texts are one group of copies; a text of fewer words than a shingle has the
whole of them as its one shingle; texts of any length are read whole; repeated rows are copies of each
other; null ids never are a component's id unless a component has no other; ties go to the smallest id,
then to the first row; an empty table gives an empty table. Columns beside ``doc_id`` and ``text`` are not
read, and ``keep_one`` hands them through untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import hashing as H
from .components import connected_components

SEED, SHINGLE, DISTANCE = 42, 3, 2
SEGMENT = 32
STAGE_SHINGLE, SIMILARITY = 5, 0.8
PLACES, SEGMENT_PLACES = 24, 6
#: One of DRAWN texts tells the frequent shingles, those of FREQUENT such texts, the MOST_LAST most frequent at most.
DRAWN, FREQUENT, MOST_LAST = 16, 8, 100_000
AT_ONCE = 500  # partners of one text in a task
PER_BUCKET = 4  # distinct shingles for each bucket of a sketch, at most, on average
_BLOCK = 255 * 256  # shingles at once; 255 of them can be summed in a byte


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number. ASCII letters are lower-cased, words end at ASCII white space."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        joined, n = [b" ".join(words)], 1
    else:
        n = len(words) - shingle + 1
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((digest(s, SEED) for s in joined), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        part = hashes[at : at + _BLOCK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints ``fp`` within DISTANCE that connect as all such pairs do."""
    low = F.lit((1 << SEGMENT) - 1)
    k = F.col("k")
    segment = F.when(k < SEGMENT, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", SEGMENT))
    gone = F.element_at(F.array(*[F.lit(~(1 << p) & ((1 << SEGMENT) - 1)) for p in range(SEGMENT)]), k % SEGMENT + 1)
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT - 1))).alias("k")).select("fp", F.shiftleft(k.cast("long"), SEGMENT).bitwiseOR(segment.bitwiseAND(gone)).alias("variant"))
    met = C.materialize(variants.groupBy("variant").agg(F.count("*").alias("n")).filter("n > 1").select("variant"), "variants")
    # A variant's members are the fingerprints with one of its two segments: 2 rows each to join, not 64.
    kind = F.shiftright("variant", SEGMENT)
    bit = F.element_at(F.array(*[F.lit(1 << p) for p in range(SEGMENT)]), (kind % SEGMENT + 1).cast("int"))
    masked = F.col("variant").bitwiseAND(low)
    whole = met.select((kind < SEGMENT).alias("is_low"), F.explode(F.array(masked, masked.bitwiseOR(bit))).alias("segment")).distinct()
    cut = F.array(F.struct(F.lit(True).alias("is_low"), F.col("fp").bitwiseAND(low).alias("segment")), F.struct(F.lit(False).alias("is_low"), F.shiftrightunsigned("fp", SEGMENT).alias("segment")))
    near = prints.select("fp", F.inline(cut)).join(whole, ["is_low", "segment"], "left_semi").select("fp").distinct()
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << p if p < 63 else -(1 << 63)) for p in range(64)])
    centres = near.select("fp", F.explode(bits).alias("bit")).groupBy(F.col("fp").bitwiseXOR(F.col("bit")).alias("centre")).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return centres.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b").distinct()


def _components(prints: DataFrame) -> DataFrame:
    """``fp`` and ``component_id`` from ``fp`` and its smallest ``first``."""
    labels = connected_components(links(prints))
    known = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = known.filter("label is not null").groupBy("label").agg(F.min("first").alias("component_id"))
    return known.join(least, "label").select("fp", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id``, the smallest id that links reach."""
    marked = C.materialize(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    prints = C.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    found = marked.join(_components(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, (n, 2), dtype=np.uint64) | np.uint64(1)


def min_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of its shingles, repeats included, and PLACES min-hashes; texts of fewer words have none."""
    n, out, seeds = np.zeros(len(column), np.int64), np.zeros((len(column), PLACES), np.uint64), _seeds(PLACES)
    for lo, hi, words, bounds in H.words_of(column, H.VISIBLE):
        h = H.shingle_hashes(words, STAGE_SHINGLE)
        size = np.maximum(np.diff(bounds) - STAGE_SHINGLE + 1, 0)
        some = np.flatnonzero(size)
        n[lo:hi] = size
        if not len(some):
            continue
        place = np.arange(len(h))
        outside = place + STAGE_SHINGLE > bounds[np.searchsorted(bounds, place, side="right")]
        for k in range(PLACES):
            with np.errstate(over="ignore"):
                v = H.mix(h * seeds[k, 0] + seeds[k, 1])
            v[outside] = np.uint64((1 << 64) - 1)
            out[some + lo, k] = np.minimum.reduceat(v, bounds[:-1][some])
    return n, out


def variants(column: pa.Array) -> pa.Array:
    """Of each text the hashes of all segments of its signature with one place deleted; none for texts without a shingle."""
    n, signature = min_hashes(column)
    some, keys = np.flatnonzero(n), []
    for start in range(0, PLACES, SEGMENT_PLACES):
        for gone in range(start, start + SEGMENT_PLACES):
            key = np.full(len(some), gone + 1, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(start, start + SEGMENT_PLACES):
                    if k != gone:
                        key = H.mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[some, k])
            keys.append(key.view(np.int64))
    offsets = np.concatenate(([0], np.cumsum((n > 0) * PLACES))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.stack(keys, 1).ravel(), pa.int64()))


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    words = text.lower().split()
    width = min(STAGE_SHINGLE, len(words))
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if words else set()


def alike(a: set, b: set) -> bool:
    """Is the Jaccard similarity SIMILARITY or more? Two empty sets are alike."""
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def _same_words(of_a: pd.Series, of_b: pd.Series) -> pd.Series:
    last, held, out = None, set(), []
    for x, y in zip(of_a, of_b, strict=True):
        if last is None or y != last:
            last, held = y, shingles(bytes(y))
        out.append(alike(shingles(bytes(x)), held))
    return pd.Series(out, dtype=bool)


def sketch(own: np.ndarray) -> bytes:
    """How many of the distinct shingles fall on each of 2^k buckets, one for two to four shingles; nothing if a byte can't hold it."""
    size = 1 << max(0, int(np.ceil(np.log2(max(1, len(own)) / PER_BUCKET))))
    counts = np.bincount(own & (size - 1), minlength=size)
    return counts.astype(np.uint8).tobytes() if len(own) and counts.max() < 256 else b""


def may_be_alike(a: bytes, b: bytes) -> bool:
    """False only if the texts of two sketches can't be alike: no bucket holds more common shingles than the lesser count."""
    if not a or not b:
        return True
    x, y = (np.frombuffer(s, np.uint8).reshape(-1, min(len(a), len(b))).sum(axis=0, dtype=np.int64) for s in (a, b))
    return bool(np.minimum(x, y).sum() >= SIMILARITY / (1 + SIMILARITY) * (x.sum() + y.sum()) - 1e-6)


def _same_buckets(of_a: pd.Series, of_b: pd.Series) -> pd.Series:
    return pd.Series([may_be_alike(x, y) for x, y in zip(of_a, of_b, strict=True)], dtype=bool)


def _verified(pairs: DataFrame, texts: DataFrame, test=_same_words) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes whose ``texts`` (node, text) pass the test; a ``b`` with many partners is dealt to many tasks."""
    parts = F.ceil(F.col("n") / AT_ONCE).cast("int")
    many = pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", parts.alias("parts"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    copies = many.join(texts, F.col("b") == F.col("node")).select("b", F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    near = F.pandas_udf(test, "boolean")
    both = dealt.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(copies, ["b", "part"])
    return both.filter(near("text_a", "text_b")).select("a", "b")


def _stars(met: DataFrame, weight: Column) -> DataFrame:
    """Distinct pairs (a, b) of rows (key, node, ...) where ``b`` is the node of most ``weight`` of a key and ``a`` another."""
    stand = met.groupBy("key").agg(F.max(F.struct(weight.alias("weight"), F.col("node").alias("b"))).alias("s")).select("key", F.col("s.b").alias("b"))
    return met.join(stand, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _links_of_texts(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between alike nodes, written, from their ``keys`` (node, keys) and ``texts`` (at, text), of which ``at`` may be a node.

    Texts are shuffled once, and kept only of nodes that meet others. Joins that grow with the input are told to
    shuffle, so that their cost is in proportion at any size.
    """
    rows = keys.select("node", F.explode("keys").alias("key"))
    full = rows.groupBy("key").count().filter("count > 1")
    met = C.materialize(rows.join(full.hint("shuffle_hash"), "key"), "met")
    company = met.groupBy("node").agg(F.sum("count").alias("company"))
    texts = texts.join(company.select(F.col("node").alias("at")).hint("shuffle_hash"), "at", "left_semi")
    texts = C.materialize(texts.select(F.col("at").alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), "met-texts")
    known = met.join(company, "node")
    pairs = C.materialize(_stars(known, F.col("company")), "pairs")
    first = C.materialize(_verified(pairs, texts), "alike")
    unlike = pairs.join(first, ["a", "b"], "left_anti").select("a").distinct()
    drawn = F.xxhash64("key", "node")
    others = _stars(met, drawn).unionByName(_stars(known, F.struct("company", drawn))).distinct()
    others = others.join(unlike, "a", "left_semi").join(pairs, ["a", "b"], "left_anti")
    others = C.materialize(others, "pairs")
    found = C.materialize(first.unionByName(_verified(others, texts)), "links")
    for done in (met, texts, pairs, first, others):
        C.discard(done)
    return found


def distinct_shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles; none if it has fewer words."""
    for lo, hi, words, bounds in H.words_of(column, H.VISIBLE):
        h = H.shingle_hashes(words, STAGE_SHINGLE)
        for k in range(hi - lo):
            yield np.unique(h[bounds[k] : max(bounds[k], bounds[k + 1] - STAGE_SHINGLE + 1)]).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def prefix(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The number of shingles, then the first of them, so many that an alike text has one of its own first among them.

    Any order that all texts share will do: here those of ``last`` (sorted), the frequent ones, stand behind the others.
    """
    n = len(own)
    behind = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own if len(last) else np.zeros(n, bool)
    first = np.concatenate((own[~behind], own[behind]))[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
    return np.concatenate(([n], first)) if n else first


def _missed(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """All edges (a, b) between alike nodes of different ``labels`` (node, label), written, by an exact join.

    ``texts`` (node, text) may hold rows that are no nodes.

    Two alike texts share one of their first shingles (``prefix``). A shingle whose texts all have one label is done
    with. Of the others, pairs whose lengths and places in the order leave too few common shingles are not compared.
    Nor are pairs whose sketches, a small part of the texts, leave too few. Whole texts go only with the pairs that remain.
    """
    every = F.arrow_udf(lambda c: _lists(list(distinct_shingles(c))), "array<long>")
    drawn = texts.filter(F.pmod(F.xxhash64("node"), F.lit(DRAWN)) == 0).select(F.explode(every("text")).alias("key")).groupBy("key").count()
    frequent = C.materialize(drawn.filter(F.col("count") >= FREQUENT).orderBy(F.desc("count")).limit(MOST_LAST).select("key"), "frequent")
    last = np.sort(np.array([r["key"] for r in frequent.collect()], np.int64))
    first = F.arrow_udf(lambda c: _lists([prefix(own, last) for own in distinct_shingles(c)]), "array<long>")
    rows = texts.select("node", first("text").alias("keys")).join(labels.hint("shuffle_hash"), "node").select("node", "label", F.get("keys", F.lit(0)).cast("int").alias("n"), F.posexplode("keys").alias("pos", "key")).filter("pos > 0")
    of_key = W.partitionBy("key")
    mixed = rows.withColumns({"lo": F.min("label").over(of_key), "hi": F.max("label").over(of_key)}).filter("lo < hi").drop("lo", "hi")
    mixed = C.materialize(mixed, "mixed")
    a, b = (mixed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "label", "n", "pos")]) for side in "ab")
    lengths = (F.col("n_a") >= SIMILARITY * F.col("n_b") - 1e-9) & (F.col("n_b") >= SIMILARITY * F.col("n_a") - 1e-9)
    both = a.join(b, (a["key"] == b["key"]) & (F.col("label_a") < F.col("label_b")) & lengths)
    both = both.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("common"), F.max("pos_a").alias("pos_a"), F.max("pos_b").alias("pos_b"))
    most = F.col("common") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    pairs = C.materialize(both.filter(most >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_a") + F.col("n_b")) - 1e-6).select("a", "b"), "rest")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    outline = F.arrow_udf(lambda c: pa.array([sketch(own) for own in distinct_shingles(c)], pa.binary()), "binary")
    sketches = texts.select("node", outline("text").alias("text")).join(ends(pairs).hint("shuffle_hash"), "node", "left_semi")
    close = C.materialize(_verified(pairs, C.materialize(sketches, "sketches"), _same_buckets), "close")
    wanted = C.materialize(ends(close), "wanted")
    held = C.materialize(texts.join(wanted, "node", "left_semi"), "rest-texts")
    found = C.materialize(_verified(close, held), "links")
    for done in (frequent, mixed, pairs, close, wanted, held):
        C.discard(done)
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays."""
    keys = F.arrow_udf(variants, "array<long>")
    words = F.trim(F.regexp_replace(C.ascii_lower(C.text_of()), rf"[{C.SPACE}]+", " "))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.md5(words.cast("binary")).alias("copy"), keys(C.text_of()).alias("keys"), F.monotonically_increasing_id().alias("at"))
    marked = C.materialize(rows, "signatures")
    # One node for each text, the place of its first row; rows in order of (id, place), null ids last.
    first = marked.groupBy("copy").agg(F.min("at").alias("node"), F.min(F.struct(F.col("id").isNull(), "id", "at")).alias("least"))
    nodes = C.materialize(first.select("node", "least"), "nodes")
    of_nodes = marked.select(F.col("at").alias("node"), "keys").join(nodes.select("node").hint("shuffle_hash"), "node", "left_semi")
    links = _links_of_texts(of_nodes, marked.select("at", F.col("row")["text"].alias("text")))
    texts = marked.select(F.col("at").alias("node"), F.coalesce(F.col("row")["text"], F.lit("")).cast("binary").alias("text"))
    label_of = nodes.select("node").join(connected_components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    labels = connected_components(links.unionByName(_missed(texts, label_of)))
    known = nodes.join(labels, "node", "left").select("least", F.coalesce("label", "node").alias("label"))
    stay = known.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.at").alias("at"))
    return marked.join(stay.hint("shuffle_hash"), "at", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(C.table(spark, sf_dir, "documents"))
