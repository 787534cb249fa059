"""Derived columns of records and features of record pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T

#: Names and order of the model's columns; ``cand_addr_ntok`` is stored but not a model input.
FEATURES = ("addr_tok_cont", "addr_3gram_jac", "addr_lev", "digit_jac", "name_tok_jac", "name_3gram_jac_translit", "name_jw_translit", "name_squash_cont", "name_ntok_diff", "addr_len_diff", "locality_overlap", "street_num_match", "addr_missing", "indic_script", "s1_name_freq_log", "digit_exact_conflict", "src_s3", "country_india", "n_cands", "cand_addr_ntok", "digit_lev_best", "digit_prefix_cont")
MODEL_FEATURES = tuple(f for f in FEATURES if f != "cand_addr_ntok")


def prepare(entities: DataFrame, candidate: bool, unicode: bool = False) -> DataFrame:
    """Once a record: normalised texts, token arrays, lengths, flags. Tokens stay arrays."""
    norm = T.norm_feature if unicode else T.norm_blocking
    base = entities.select("entity_id", "country", norm(F.col("business_name")).alias("nname"), norm(F.col("business_address")).alias("naddr"), T.is_indic(F.col("business_name")).alias("indic"), F.col("business_name").alias("raw"))
    view = F.when(F.col("indic"), norm(T.transliterate(F.col("raw")))).otherwise(F.col("nname")) if candidate and unicode else F.col("nname")
    core = T.core_tokens(F.col("nname"))
    out = base.withColumn("view", view).select(
        "entity_id", "country", "nname", "naddr", "indic", "view", core.alias("core"), T.squash(F.col("view")).alias("squash"), T.token_set(F.col("naddr")).alias("atoks"), T.char_grams(F.col("naddr")).alias("agrams"),
        T.digit_tokens(F.col("naddr")).alias("digits"), F.array_distinct(T.locality_tokens(F.col("naddr"))).alias("loc"), T.char_grams(F.col("view")).alias("ngrams"), F.length("naddr").alias("alen"), F.size(T.tokens(F.col("naddr"))).alias("addr_ntok"), F.size(core).alias("n_core"))
    # Sets are compared as arrays of 64-bit numbers, which the engine intersects without boxing.
    number = lambda a: F.transform(a, lambda t: F.xxhash64(t))
    out = out.withColumns({f"{c}_set": number(F.array_distinct(c)) for c in ("core", "atoks", "agrams", "digits", "loc", "ngrams")}).drop("agrams", "ngrams")
    if not candidate:
        # Counted before the join, so that a frequent name is one row of sums and no task's window.
        freq = out.groupBy("core").agg(F.log1p(F.count("*").cast("double")).alias("freq_log"))
        out = out.join(freq, "core")
    return out


def pair_features(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, unicode: bool = False, edit: bool = True) -> DataFrame:
    """All features of pairs (s1_id, cand_id); a pair whose record is missing is an error.

    ``n_cands`` is global to the query. ``edit`` adds Jaro-Winkler, the one feature that leaves the JVM.
    """
    a, b = prepare(queries, False, unicode), prepare(corpus, True, unicode)
    a, b = a.select([F.col(c).alias("a_" + c) for c in a.columns]), b.select([F.col(c).alias("b_" + c) for c in b.columns])
    n = pairs.groupBy("s1_id").agg(F.count("*").alias("n_cands"))
    j = pairs.select("s1_id", "cand_id").join(n, "s1_id").join(a, F.col("s1_id") == F.col("a_entity_id"), "left").join(b, F.col("cand_id") == F.col("b_entity_id"), "left")
    j = j.filter(F.when(F.col("a_entity_id").isNull() | F.col("b_entity_id").isNull(), F.raise_error(F.concat(F.lit("unknown record in pair "), "s1_id", F.lit(" "), "cand_id"))).otherwise(F.lit(True)))
    c = F.col
    one = lambda x: x.cast("double")
    got = {
        "addr_tok_cont": S.containment(c("a_atoks_set"), c("b_atoks_set")), "addr_3gram_jac": S.jaccard(c("a_agrams_set"), c("b_agrams_set")), "addr_lev": S.levenshtein_similarity(c("a_naddr"), c("b_naddr")),
        "digit_jac": S.jaccard(c("a_digits_set"), c("b_digits_set")), "name_tok_jac": S.jaccard(c("a_core_set"), c("b_core_set")), "name_3gram_jac_translit": S.jaccard(c("a_ngrams_set"), c("b_ngrams_set")),
        "name_jw_translit": T.jaro_winkler(c("a_view"), c("b_view")) if edit else F.lit(0.0), "name_squash_cont": S.squash_containment(c("a_squash"), c("b_squash")), "name_ntok_diff": one(F.abs(c("a_n_core") - c("b_n_core"))),
        "addr_len_diff": F.abs(c("a_alen") - c("b_alen")) / F.greatest(c("a_alen"), c("b_alen"), F.lit(1)), "locality_overlap": S.jaccard(c("a_loc_set"), c("b_loc_set")), "street_num_match": S.containment(c("a_digits_set"), c("b_digits_set")),
        "addr_missing": one((c("a_alen") == 0) | (c("b_alen") == 0)), "indic_script": one(c("b_indic")), "s1_name_freq_log": c("a_freq_log"),
        "digit_exact_conflict": one((F.size("a_digits") > 0) & (F.size("b_digits") > 0) & ~F.arrays_overlap("a_digits", "b_digits")), "src_s3": one(c("cand_id").startswith("S3-")), "country_india": one(c("a_country") == "India"),
        "n_cands": one(c("n_cands")), "cand_addr_ntok": one(c("b_addr_ntok")), "digit_lev_best": S.best_digit_similarity(c("a_digits"), c("b_digits")), "digit_prefix_cont": S.digit_prefix(c("a_digits"), c("b_digits")),
    }
    return j.select("s1_id", "cand_id", c("a_country").alias("country"), *[got[f].cast("float").alias(f) for f in FEATURES])


def cosines(pairs: DataFrame, weights: tuple[DataFrame, DataFrame], name: str) -> DataFrame:
    """``s1_id``, ``cand_id`` and the TF-IDF cosine ``name`` of pairs that share a weighed token."""
    q, c = weights
    q, c = q.select(F.col("entity_id").alias("s1_id"), "token", F.col("w").alias("wq")), c.select(F.col("entity_id").alias("cand_id"), "token", "w")
    return pairs.select("s1_id", "cand_id").join(q, "s1_id").join(c, ["cand_id", "token"]).groupBy("s1_id", "cand_id").agg(F.sum(F.col("wq") * F.col("w")).alias(name))


def research_features(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Study features that the model doesn't use. Cosines are of words, weighed by the corpus."""
    from .blocking import weights, words

    of = lambda field: weights(queries, corpus, words(F.col(field)))
    a, b = prepare(queries, False), prepare(corpus, True)
    a, b = a.select([F.col(c).alias("a_" + c) for c in a.columns]), b.select([F.col(c).alias("b_" + c) for c in b.columns])
    c, one = F.col, lambda x: x.cast("double")
    j = pairs.select("s1_id", "cand_id").join(a, F.col("s1_id") == F.col("a_entity_id")).join(b, F.col("cand_id") == F.col("b_entity_id"))
    for field, name in (("nname", "name_cos"), ("naddr", "addr_cos")):
        j = j.join(cosines(pairs, of(field), name), ["s1_id", "cand_id"], "left").na.fill(0.0, [name])
    pin = [T.pincode(c("a_naddr"), c("a_country")), T.pincode(c("b_naddr"), c("b_country"))]
    both, name, addr = (pin[0] != "") & (pin[1] != ""), S.jaccard(c("a_core_set"), c("b_core_set")), S.jaccard(c("a_atoks_set"), c("b_atoks_set"))
    acronym = lambda x: F.array_join(F.transform(x, lambda t: F.substring(t, 1, 1)), "")
    return j.select("s1_id", "cand_id", one(c("a_nname") == c("b_nname")).alias("name_exact_norm"), one((c("a_core") == c("b_core")) & (F.size("a_core") > 0)).alias("name_core_eq"), S.containment(c("a_core_set"), c("b_core_set")).alias("name_tok_cont"), S.levenshtein_similarity(c("a_nname"), c("b_nname")).alias("name_lev"),
                    one((acronym(c("a_core")) == c("b_squash")) | (acronym(c("b_core")) == c("a_squash"))).alias("name_acronym"), one((c("a_naddr") == c("b_naddr")) & (c("a_naddr") != "")).alias("addr_exact_norm"), addr.alias("addr_tok_jac"), one(both).alias("pin_present_both"), one(both & (pin[0] == pin[1])).alias("pin_eq"),
                    one(both & (F.substring(pin[0], 1, 3) == F.substring(pin[1], 1, 3))).alias("pin_prefix3"), one(c("a_country") == c("b_country")).alias("country_eq"), (name * addr).alias("name_addr_prod"), ((name + addr) / 2).alias("name_addr_mean"),
                    T.jaro_winkler(c("a_nname"), c("b_nname")).alias("name_jw"), S.jaccard(F.transform(T.char_grams(c("a_nname")), lambda t: F.xxhash64(t)), F.transform(T.char_grams(c("b_nname")), lambda t: F.xxhash64(t))).alias("name_3gram_jac"), one(F.abs(F.length("a_nname") - F.length("b_nname"))).alias("name_len_diff"),
                    S.jaccard(F.array_distinct(T.core_tokens(c("a_view"))), F.array_distinct(T.core_tokens(c("b_view")))).alias("name_tok_jac_translit"), "name_cos", "addr_cos")
