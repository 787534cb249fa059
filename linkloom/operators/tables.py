"""Joins, aggregations, windows and sets over tables of pairs, of entities and of any keys.

Pairs have ``s1_id`` and ``cand_id``; entities ``entity_id``, ``src``, ``country``, ``nname`` and ``naddr``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["s1_id", "cand_id"]


def source_of(cand_id: str = "cand_id") -> Column:
    return F.substring(cand_id, 1, 2)


def attributes(entities: DataFrame, key: str, **names: str) -> DataFrame:
    """The entities' columns ``names`` under new names, keyed by ``key``."""
    return entities.select(F.col("entity_id").alias(key), *[F.col(c).alias(new) for new, c in names.items()])


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``label``: 1 where the truth holds the pair, else 0."""
    return pairs.join(truth.select(*PAIR, F.lit(1).alias("label")), PAIR, "left").na.fill(0, ["label"])


def hits(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """The truth's pairs with ``hit``: 1 where ``pairs`` hold them, else 0."""
    return truth.select(*PAIR, "country").join(pairs.select(*PAIR, F.lit(1).alias("hit")), PAIR, "left").na.fill(0, ["hit"])


def misses(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return truth.select(*PAIR, "country").join(pairs, PAIR, "left_anti")


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """One row: ``tp``, ``fp`` and ``fn`` of labelled scores at a threshold."""
    taken, true = F.col("prob") >= threshold, F.col("label") == 1
    return rows.agg(F.count_if(taken & true).alias("tp"), F.count_if(taken & ~true).alias("fp"), F.count_if(~taken & true).alias("fn"))


def score_bins(rows: DataFrame, n: int = 10) -> DataFrame:
    """Labelled scores in ``n`` bins of equal width: their number, mean score and share of matches."""
    return rows.groupBy(F.floor(F.col("prob") * n).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.round(F.avg("label"), 6).alias("actual"))


def quadrants(features: DataFrame, truth: DataFrame, bound: float = 0.5) -> DataFrame:
    """Pairs and matches by whether the names and whether the addresses are alike."""
    high = lambda c, name: (F.col(c) >= bound).alias(name)
    return labelled(features, truth).groupBy(high("name_tok_jac", "name_high"), high("addr_3gram_jac", "addr_high")).agg(F.count("*").alias("n"), F.sum("label").alias("matches"))


def sliced_recall(hit: DataFrame, entities: DataFrame) -> DataFrame:
    """Recall by country, by source and by whether the candidate's name is ASCII, in one pass over the hits."""
    plain = F.when(F.octet_length("name") == F.length("name"), "ascii").otherwise("other")
    rows = hit.join(attributes(entities, "cand_id", name="nname"), "cand_id").select("hit", "country", source_of().alias("source"), plain.alias("ascii"))
    return rows.unpivot(["hit"], ["country", "source", "ascii"], "slice", "value").groupBy("slice", "value").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("recall"))


def entity_recall(hit: DataFrame) -> DataFrame:
    """The share of entities all of whose links are hit."""
    whole = hit.groupBy("s1_id").agg(F.min("hit").alias("whole"))
    return whole.agg(F.round(F.avg("whole"), 6).alias("entity_recall"), F.count("*").alias("n"))


def miss_categories(missed: DataFrame, entities: DataFrame) -> DataFrame:
    """Missed links by country and likely reason; the first that holds counts."""
    names = entities.filter("src > 1").groupBy(F.col("nname").alias("b_name")).agg(F.count("*").alias("chain"))
    q, c = attributes(entities, "s1_id", a_name="nname", a_addr="naddr", a_country="country"), attributes(entities, "cand_id", b_name="nname", b_addr="naddr")
    rows = missed.select(*PAIR).join(q, "s1_id").join(c, "cand_id").join(names, "b_name")
    why = F.when((F.col("a_addr") == "") | (F.col("b_addr") == ""), "empty_address").when(F.col("a_name") != F.col("b_name"), "other_name").when(F.length("a_name") < 12, "short_name").when(F.col("chain") >= 5, "chain").otherwise("common_words")
    return rows.groupBy(F.col("a_country").alias("country"), why.alias("category")).agg(F.count("*").alias("misses"))


def with_attributes(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs with both names and the candidate's address; unknown records have none."""
    found = pairs.select(*PAIR).join(attributes(entities, "s1_id", s1_name="nname"), "s1_id", "left")
    return found.join(attributes(entities, "cand_id", cand_name="nname", cand_addr="naddr"), "cand_id", "left")


def key_study(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """How many links exact keys would find: name or address, alone and with the country; one row a key."""
    q, c = attributes(entities, "s1_id", a_name="nname", a_addr="naddr", a_in="country"), attributes(entities, "cand_id", b_name="nname", b_addr="naddr", b_in="country")
    same = lambda f: (F.col(f"a_{f}") == F.col(f"b_{f}")) & (F.col(f"a_{f}") != "")
    one_in = F.col("a_in") == F.col("b_in")
    methods = {"name": same("name"), "name_country": same("name") & one_in, "addr": same("addr"), "addr_country": same("addr") & one_in}
    counted = truth.select(*PAIR).join(q, "s1_id").join(c, "cand_id").agg(F.count("*").alias("n_true"), *[F.count_if(e).alias(n) for n, e in methods.items()])
    return counted.select("n_true", F.inline(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("hits")) for n in methods])))


def links_of_entities(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """Each S1 entity with its number of links, and of those to either source, zero included."""
    of = truth.groupBy(F.col("s1_id").alias("entity_id")).agg(F.count("*").alias("n"), *[F.count_if(source_of() == s).alias(s.lower()) for s in ("S2", "S3")])
    return entities.filter("src = 1").select("entity_id").join(of, "entity_id", "left").na.fill(0, ["n", "s2", "s3"])


def link_shapes(per: DataFrame) -> DataFrame:
    """One row: entities by how many links they have and in which sources."""
    shapes = {"none": "n = 0", "one": "n = 1", "several": "n >= 2", "only_s2": "s2 > 0 and s3 = 0", "only_s3": "s3 > 0 and s2 = 0", "both_sources": "s2 > 0 and s3 > 0"}
    return per.agg(F.count("*").alias("entities"), *[F.count_if(F.expr(e)).alias(n) for n, e in shapes.items()])


def frequency_buckets(rows: DataFrame, cores: DataFrame) -> DataFrame:
    """Labelled pairs of equal core name by how many S1 entities have it, with their share of matches."""
    n = F.col("n")
    bucket = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 10, "4-10").when(n <= 100, "11-100").otherwise("over 100")
    known = cores.filter("core <> ''")
    often = known.filter(F.col("entity_id").startswith("S1-")).groupBy("core").agg(F.count("*").alias("n"))
    q = known.join(often, "core").select(F.col("entity_id").alias("s1_id"), "core", "n")
    both = rows.select(*PAIR, "label").join(q, "s1_id").join(attributes(known, "cand_id", core="core"), ["cand_id", "core"])
    return both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("pairs"), F.round(F.avg("label"), 6).alias("matched"))


def flagged(features: DataFrame, scored: DataFrame, cores: DataFrame, entities: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Pairs with a boolean for each of ``flags``, for equal core names and for names that hold a web address."""
    name = lambda d, key, new: d.select(F.col("entity_id").alias(key), F.col(d.columns[1]).alias(new))
    rows = features.join(scored.select(*PAIR, "prob"), PAIR)
    for d, new in ((cores, "core"), (entities.select("entity_id", "nname"), "name")):
        rows = rows.join(name(d, "s1_id", f"a_{new}"), "s1_id").join(name(d, "cand_id", f"b_{new}"), "cand_id")
    web = lambda c: F.concat(F.lit(" "), c, F.lit(" ")).rlike(" (www|com) ")
    same = (F.col("a_core") == F.col("b_core")) & (F.col("a_core") != "")
    return rows.select(*PAIR, same.alias("exact_core_name"), *[F.expr(e).alias(n) for n, e in flags.items()], (web("a_name") | web("b_name")).alias("dba_domain"))


def ranked(rows: DataFrame, key: str, *order: Column, k: int | None = None, name: str = "k") -> DataFrame:
    """Adds the 0-based rank within a key; with ``k`` only the first that many stay."""
    found = rows.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)
    return found if k is None else found.filter(F.col(name) < k)


def group_size(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a key's number of rows: counted before it is shuffled, then joined."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias(name)), key)


def running_sum(rows: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """Adds ``running``, the sum of ``value`` within a key up to the row."""
    return rows.withColumn("running", F.sum(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def zero_filled_counts(keys: DataFrame, rows: DataFrame, key: str, of: str, name: str = "n") -> DataFrame:
    """Each of ``keys`` with its number of ``rows`` (whose key is ``of``), zero included."""
    return keys.select(key).join(rows.groupBy(F.col(of).alias(key)).agg(F.count("*").alias(name)), key, "left").na.fill(0, [name])


def of_keys(rows: DataFrame, key: str, keys: DataFrame, of: str, held: bool = True) -> DataFrame:
    """The rows whose key is (or with ``held`` false is not) among ``keys``; null keys are among none."""
    return rows.join(keys.select(F.col(of).alias(key)), key, "left_semi" if held else "left_anti")
