"""The rest of the registry: sources and sinks, projections, single joins, aggregations, windows, scalar functions, checks.

Sinks are written to the shared folder and read back, so what is compared is what a reader finds there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocking, decide, features, learn, tables, validate
from ..sources import files
from . import entities as E
from .queries import _CTE, _F05, _FEATS, _FLAGS, _GRID, _INPUT, _LABEL, ORACLE_SQL, QUERIES, _grams, _over, _query, _toks, _trained

_CTE["lists"] = (("ent", "scored"), ORACLE_SQL["agg_join_list"][ORACLE_SQL["agg_join_list"].rindex("\nSELECT") + 1 :])
_CTE["matched"] = (("scored",), "SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS n FROM scored WHERE prob >= 0.625) WHERE n = 1")
_INPUT |= {"lists": E.lists, "matched": lambda s, d: decide.one_to_one(E.scored(s, d).filter("prob >= 0.625")).select("s1_id", "cand_id")}

# Sources and sinks.
_ROWS = "SELECT entity_id, '\"' || nname || '\"' AS business_name, naddr AS business_address, country FROM ent"


def _entity_file(s: SparkSession, d: str) -> str:
    """The entity view as a tab-separated text whose names stand in quotes."""
    path = files.workspace(s, "entities")
    rows = E.entities(s, d).select("entity_id", F.concat(F.lit('"'), "nname", F.lit('"')).alias("business_name"), F.col("naddr").alias("business_address"), "country")
    rows.write.options(sep="\t", header=True, quote="", emptyValue="").csv(path)
    return path


def _again(name: str, write, read=None):
    """A query that writes to a new place in the shared folder and reads it back."""
    def plan(s: SparkSession, d: str) -> DataFrame:
        path = files.workspace(s, name)
        write(s, d, path)
        return s.read.parquet(path) if read is None else read(s, path)

    return plan


_query("scan_tsv", lambda s, d: files.read_tsv(s, _entity_file(s, d)), _ROWS, "ent")
_query("scan_arrow_csv", lambda s, d: files.read_tsv(s, _entity_file(s, d)), _ROWS, "ent")
_query("scan_tsv_quoted", lambda s, d: files.read_quoted_tsv(s, _entity_file(s, d)), "SELECT entity_id, nname AS business_name, naddr AS business_address, country FROM ent", "ent")
_query("scan_prefix", lambda s, d: files.read_first_rows(s, _entity_file(s, d), 20), f"{_ROWS} ORDER BY entity_id LIMIT 20", "ent")
_query("scan_first_column_ids", lambda s, d: files.read_first_column(s, _entity_file(s, d)), "SELECT DISTINCT entity_id FROM ent", "ent")
_over("scan_columns", "SELECT doc_id, lang FROM {documents}", "documents", plan=lambda x: x.select("doc_id", "lang"))
_query("scan_id_list", _again("ids", lambda s, d, p: E.sides(s, d)[0].select("entity_id").write.text(p), files.read_ids), "SELECT entity_id FROM ent WHERE src = 1", "ent")
_query("scan_json", _again("manifest", lambda s, d, p: files.write_manifest(s, p, {"shards": 3, "exact_cap": 200}), lambda s, p: s.createDataFrame(sorted(files.read_manifest(s, p).items()), "key string, value long")), "SELECT unnest(['exact_cap', 'shards']) AS key, unnest([200, 3]) AS value")
_query("scan_parquet_dir", _again("parts", lambda s, d, p: files.write_parts(E.entities(s, d).select("entity_id", "country", "nname"), p)), "SELECT entity_id, country, nname FROM ent", "ent")
_query("sink_parquet_parts", _again("pairs", lambda s, d, p: files.write_parts(E.candidates(s, d), p)), "SELECT * FROM cand", "cand")


def _write_twice(s: SparkSession, d: str, path: str) -> None:
    """The second write takes the first one's place as a whole."""
    e = E.entities(s, d).select("entity_id", "country")
    files.write_parts(e.filter("entity_id < 'S2'"), path)
    files.write_parts(e.filter("entity_id >= 'S2'"), path)


_query("sink_atomic", _again("atomic", _write_twice), "SELECT entity_id, country FROM ent WHERE src > 1", "ent")
_RESULT = "source1_entity_id string, matched_entity_ids string"
_query("sink_result_tsv", _again("result", lambda s, d, p: files.write_result(E.lists(s, d), p), lambda s, p: files.read_tsv(s, p, _RESULT)), "SELECT * FROM lists", "lists")


def _append_counts(s: SparkSession, d: str, path: str) -> None:
    for src in (1, 2, 3):
        files.append_metrics(E.entities(s, d).filter(F.col("src") == src).agg(F.lit(f"S{src}").alias("source"), F.count("*").alias("n")), path)


_query("sink_csv_append", _again("metrics", _append_counts, lambda s, p: s.read.schema("source string, n long").option("header", True).csv(p)), "SELECT 'S' || src AS source, count(*) AS n FROM ent GROUP BY src", "ent")
_query("sink_shard_tsv", _again("shards", lambda s, d, p: files.write_shards(E.truth(s, d).select("s1_id", "cand_id", T.shard_of(F.col("s1_id"), 3).alias("shard")), p), lambda s, p: s.read.schema("s1_id string, cand_id string, shard int").options(sep="\t", header=True, quote="").csv(p)),
       "SELECT s1_id, cand_id, shard FROM truth JOIN (" + ORACLE_SQL["shard_of"][ORACLE_SQL["shard_of"].rindex("\nSELECT") + 1 :] + ") h ON h.entity_id = s1_id", "truth")
_query("sink_npz", _again("vectors", lambda s, d, p: E.scored(s, d).groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_id", "prob"))), lambda x: x["prob"]).alias("probs")).write.parquet(p), lambda s, p: s.read.parquet(p).select("s1_id", F.size("probs").alias("n"), F.round(F.array_max("probs"), 5).alias("most"))), "SELECT s1_id, count(*)::INT AS n, max(prob) AS most FROM scored GROUP BY s1_id", "scored")


def _shards(s: SparkSession, d: str, n: int = 3) -> list[tuple[DataFrame, DataFrame]]:
    pairs, index = E.candidates(s, d), E.index(s, d)
    return [(pairs.filter(T.shard_of(F.col("s1_id"), n) == k), index.filter(T.shard_of(F.col("s1_id"), n) == k)) for k in range(n)]


def _copied(s: SparkSession, d: str) -> DataFrame:
    paths = []
    for k in range(3):
        paths.append(files.workspace(s, f"shard{k}"))
        E.truth(s, d).filter(T.shard_of(F.col("s1_id"), 3) == k).write.parquet(paths[-1])
    to = files.workspace(s, "copied")
    files.copy_parts(s, paths, to)
    return s.read.parquet(to).select("s1_id", "cand_id", "country")


_query("copy_parts", _copied, "SELECT * FROM truth", "truth")
_query("merge_shards", lambda s, d: validate.merge_shards(_shards(s, d), [{"shard_id": k, "num_shards": 3, "done": True, "exact_cap": 200} for k in range(3)])[0], "SELECT * FROM cand", "cand")

# Projections, filters, predicates.
_over("project_rename", "SELECT entity_id AS record_id, nname AS business_name, naddr AS business_address FROM {ent}", "ent", plan=lambda e: e.select("entity_id", "nname", "naddr").toDF("record_id", "business_name", "business_address"))
_over("filter_eq_country", "SELECT entity_id, nname FROM {ent} WHERE country = 'en'", "ent", plan=lambda e: e.filter(F.col("country") == "en").select("entity_id", "nname"))
_over("filter_threshold", "SELECT s1_id, cand_id, prob FROM {scored} WHERE prob >= 0.625", "scored", plan=lambda s: s.filter(F.col("prob") >= 0.625).select("s1_id", "cand_id", "prob"))
_over("filter_nonempty", "SELECT entity_id FROM {ent} WHERE nname <> '' AND naddr <> ''", "ent", plan=lambda e: e.filter((F.length("nname") > 0) & (F.length("naddr") > 0)).select("entity_id"))
_over("prefix_source", "SELECT cand_id, substring(cand_id, 1, 2) AS source, CASE WHEN cand_id LIKE 'S3%' THEN 1 ELSE 0 END AS src_s3 FROM {truth}", "truth", plan=lambda t: t.select("cand_id", tables.source_of().alias("source"), F.col("cand_id").startswith("S3").cast("int").alias("src_s3")))
_over("conditional_mask", "SELECT entity_id, CASE WHEN nname = '' THEN '<EMPTY>' ELSE nname END AS business_name FROM {ent}", "ent", plan=lambda e: e.select("entity_id", F.coalesce(F.nullif("nname", F.lit("")), F.lit("<EMPTY>")).alias("business_name")))
_over("fillna", "SELECT u.s1_id, u.cand_id, coalesce(c.word_rank, -1) AS word_rank, coalesce(c.channels, 0) AS channels FROM {truth} u LEFT JOIN {cand} c ON c.s1_id = u.s1_id AND c.cand_id = u.cand_id", "truth", "cand", plan=lambda t, c: t.select(*tables.PAIR).join(c.select(*tables.PAIR, "word_rank", "channels"), tables.PAIR, "left").na.fill({"word_rank": -1, "channels": 0}))
_over("cast_narrow", "SELECT s1_id, cand_id, CAST(channels AS SMALLINT) AS channels, CAST(word_rank AS SMALLINT) AS word_rank FROM {cand}", "cand", plan=lambda c: c.select("s1_id", "cand_id", *[F.col(x).cast("smallint").alias(x) for x in ("channels", "word_rank")]))
_over("bitmask_or", "SELECT s1_id, bit_or(channels) AS channels, CAST(sum(CASE WHEN (channels & 1) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS by_word, CAST(sum(CASE WHEN (channels & 4) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS by_name FROM {cand} GROUP BY s1_id", "cand", plan=lambda c: c.groupBy("s1_id").agg(F.bit_or("channels").alias("channels"), *[F.count_if(F.col("channels").bitwiseAND(bit) > 0).alias(n) for n, bit in (("by_word", blocking.WORD), ("by_name", blocking.EXACT))]))
_query("regex_contains", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.col("t").rlike(r"[^\x00-\x7F]").alias("non_ascii"), F.col("t").rlike("[\\u0900-\\u097F]").alias("devanagari"), T.is_indic(F.col("t")).alias("indic"), F.col("t").rlike(r"[0-9]").alias("digit")),
       r"SELECT doc_id, regexp_matches(t, '[^\x00-\x7F]') AS non_ascii, regexp_matches(t, '[\x{0900}-\x{097F}]') AS devanagari, regexp_matches(t, '[\x{0900}-\x{0D7F}]') AS indic, regexp_matches(t, '[0-9]') AS digit FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
_BOOLS = {"exact_core_name": "a.core = b.core AND a.core <> ''", **_FLAGS}
_CTE["cores"] = (("prep",), "SELECT entity_id, array_to_string(core, ' ') AS core FROM prep")
_INPUT["cores"] = lambda s, d: E.entities(s, d).select("entity_id", F.array_join(T.core_tokens(F.col("nname")), " ").alias("core"))
_WWW = "' ' || x.nname || ' ' LIKE '% www %' OR ' ' || x.nname || ' ' LIKE '% com %' OR ' ' || y.nname || ' ' LIKE '% www %' OR ' ' || y.nname || ' ' LIKE '% com %'"
_over("bool_flags", "SELECT f.s1_id, f.cand_id, " + ", ".join(f"{e} AS {n}" for n, e in _BOOLS.items()) + f", {_WWW} AS dba_domain FROM {{feat}} f JOIN {{scored}} s ON s.s1_id = f.s1_id AND s.cand_id = f.cand_id JOIN {{cores}} a ON a.entity_id = f.s1_id JOIN {{cores}} b ON b.entity_id = f.cand_id JOIN {{ent}} x ON x.entity_id = f.s1_id JOIN {{ent}} y ON y.entity_id = f.cand_id", "feat", "scored", "cores", "ent", plan=lambda f, s, c, e: tables.flagged(f, s, c, e, _FLAGS))

# Joins.
_over("join_exact_keys_study", " UNION ALL ".join(f"SELECT '{n}' AS method, count(*) AS n_true, CAST(sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM {{truth}} u JOIN {{ent}} a ON a.entity_id = u.s1_id JOIN {{ent}} b ON b.entity_id = u.cand_id" for n, e in (
    ("name", "a.nname = b.nname AND a.nname <> ''"), ("name_country", "a.nname || '||' || a.country = b.nname || '||' || b.country AND a.nname <> ''"), ("addr", "a.naddr = b.naddr AND a.naddr <> ''"), ("addr_country", "a.naddr || '||' || a.country = b.naddr || '||' || b.country AND a.naddr <> ''"))), "truth", "ent", plan=tables.key_study)
_over("join_attr_left", "SELECT c.s1_id, c.cand_id, a.nname AS s1_name, b.nname AS cand_name, b.naddr AS cand_addr FROM {cand} c LEFT JOIN {ent} a ON a.entity_id = c.s1_id LEFT JOIN {ent} b ON b.entity_id = c.cand_id", "cand", "ent", plan=tables.with_attributes)


def _lookup(s: SparkSession, d: str) -> DataFrame:
    """An unknown record is an error, not a missing row."""
    e = E.entities(s, d).select(F.col("entity_id").alias("cand_id"), "src", F.lit(True).alias("known"))
    known = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown record "), "cand_id"))).otherwise(F.lit(True))
    return E.truth(s, d).join(e, "cand_id", "left").filter(known).select("s1_id", "cand_id", "src")


_query("join_lookup_strict", _lookup, "SELECT s1_id, cand_id, src FROM truth JOIN ent ON entity_id = cand_id", "truth", "ent")
_over("join_meta_left", "SELECT i.s1_id, i.country, i.n_cands, coalesce(t.n_true, 0) AS n_true FROM {idx} i LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM {truth} GROUP BY s1_id) t ON t.s1_id = i.s1_id", "idx", "truth", plan=lambda i, t: i.select("s1_id", "country", "n_cands").join(tables.zero_filled_counts(i, t, "s1_id", "s1_id", "n_true"), "s1_id"))
_over("join_semi_scope", "SELECT s1_id, cand_id FROM {truth} t WHERE EXISTS (SELECT 1 FROM {idx} i WHERE i.s1_id = t.s1_id AND i.n_cands > 0)", "truth", "idx", plan=lambda t, i: tables.of_keys(t, "s1_id", i.filter("n_cands > 0"), "s1_id").select("s1_id", "cand_id"))
_over("join_map_dict", "SELECT c_custkey, n_name, r_name FROM {customer} LEFT JOIN {nation} ON n_nationkey = c_nationkey LEFT JOIN {region} ON r_regionkey = n_regionkey", "customer", "nation", "region", plan=lambda c, n, r: c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name"))
_over("join_row_aligned", "SELECT s.s1_id, s.cand_id, s.prob, c.channels FROM {scored} s JOIN {cand} c ON c.s1_id = s.s1_id AND c.cand_id = s.cand_id", "scored", "cand", plan=lambda s, c: s.select(*tables.PAIR, "prob").join(c.select(*tables.PAIR, "channels"), tables.PAIR))
_over("join_token_cross", "SELECT s1_id, cand_id, round(CAST(digit_lev_best AS DOUBLE), 4) AS best, CAST(digit_prefix_cont AS INT) AS prefix FROM {feat}", "feat", plan=lambda f: f.select("s1_id", "cand_id", F.round(F.col("digit_lev_best").cast("double"), 4).alias("best"), F.col("digit_prefix_cont").cast("int").alias("prefix")))

# Aggregations.
_over("agg_count_per_s1", "SELECT s1_id, count(*) AS n FROM {cand} GROUP BY s1_id", "cand", plan=lambda c: c.groupBy("s1_id").agg(F.count("*").alias("n")))
_over("agg_sum_per_s1", "SELECT s1_id, CAST(sum(n) AS BIGINT) AS n_cands FROM (SELECT s1_id, channels, count(*) AS n FROM {cand} GROUP BY s1_id, channels) x GROUP BY s1_id", "cand", plan=lambda c: c.groupBy("s1_id", "channels").count().groupBy("s1_id").agg(F.sum("count").alias("n_cands")))
_LEN = ("nname", "naddr")
_query("agg_len_stats", lambda s, d: (lambda e: e.unpivot(["src"], list(_LEN), "field", "text").groupBy("src", "field").agg(F.round(F.avg(F.length("text")), 6).alias("mean"), *[F.floor(F.percentile(F.length("text"), p)).alias(n) for n, p in (("median", 0.5), ("p5", 0.05), ("p95", 0.95))], F.max(F.length("text")).alias("most"), F.round(F.avg((F.col("text") == "").cast("int")), 6).alias("empty")))(E.entities(s, d).select("src", *_LEN)),
       " UNION ALL ".join(f"SELECT src, '{f}' AS field, round(avg(length({f})), 6) AS mean, floor(quantile_cont(length({f}), 0.5))::BIGINT AS median, floor(quantile_cont(length({f}), 0.05))::BIGINT AS p5, floor(quantile_cont(length({f}), 0.95))::BIGINT AS p95, max(length({f})) AS most, round(avg(({f} = '')::INT), 6) AS empty FROM ent GROUP BY src" for f in _LEN), "ent")
_PER = "SELECT e.entity_id, count(t.cand_id) AS n, CAST(coalesce(sum(CASE WHEN t.cand_id LIKE 'S2-%' THEN 1 ELSE 0 END), 0) AS BIGINT) AS s2, CAST(coalesce(sum(CASE WHEN t.cand_id LIKE 'S3-%' THEN 1 ELSE 0 END), 0) AS BIGINT) AS s3 FROM {ent} e LEFT JOIN {truth} t ON t.s1_id = e.entity_id WHERE e.src = 1 GROUP BY e.entity_id"
_over("agg_conditional", f"SELECT count(*) AS entities, count_if(n = 0) AS none, count_if(n = 1) AS one, count_if(n >= 2) AS several, count_if(s2 > 0 AND s3 = 0) AS only_s2, count_if(s3 > 0 AND s2 = 0) AS only_s3, count_if(s2 > 0 AND s3 > 0) AS both_sources FROM ({_PER}) x", "ent", "truth", plan=lambda e, t: tables.link_shapes(tables.links_of_entities(e, t)))
_over("agg_histogram", f"SELECT n AS n_matches, count(*) AS entities FROM ({_PER}) x GROUP BY n ORDER BY entities DESC, n_matches LIMIT 20", "ent", "truth", plan=lambda e, t: tables.links_of_entities(e, t).groupBy(F.col("n").alias("n_matches")).agg(F.count("*").alias("entities")).orderBy(F.desc("entities"), "n_matches").limit(20))
_query("agg_collect_set", lambda s, d: E.sides(s, d)[1].groupBy("country", "nname").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids")), "SELECT country, nname, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS ids FROM ent WHERE src > 1 GROUP BY country, nname", "ent")
_over("agg_first", "SELECT s1_id, max(country) AS country FROM {cand} GROUP BY s1_id", "cand", plan=lambda c: c.groupBy("s1_id").agg(F.max("country").alias("country")))
_over("agg_segment_max", "SELECT s1_id, max(prob) AS best FROM {scored} GROUP BY s1_id", "scored", plan=lambda s: s.groupBy("s1_id").agg(F.max("prob").alias("best")))
_BUCKET = "CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' WHEN n <= 100 THEN '11-100' ELSE 'over 100' END"
_over("agg_freq_bucket", f"SELECT {_BUCKET} AS bucket, count(*) AS pairs, round(avg(label), 6) AS matched FROM (SELECT y.label, k.n FROM ({_LABEL}) y JOIN {{cores}} a ON a.entity_id = y.s1_id JOIN {{cores}} b ON b.entity_id = y.cand_id AND b.core = a.core JOIN (SELECT core, count(*) AS n FROM {{cores}} WHERE entity_id LIKE 'S1-%' GROUP BY core) k ON k.core = a.core WHERE a.core <> '') z GROUP BY {_BUCKET}", "scored", "truth", "cores", plan=lambda s, t, c: tables.frequency_buckets(tables.labelled(s, t), c))
_query("agg_macro_f05", lambda s, d: decide.entity_counts(E.index(s, d), _INPUT["matched"](s, d), E.truth(s, d)).groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg(decide.f05(F.col("n_pred"), F.col("n_true"), F.col("tp"))), 6).alias("macro_f05")),
       f"SELECT country, count(*) AS n, round(avg({_F05}), 6) AS macro_f05 FROM (SELECT i.country, (SELECT count(*) FROM matched p WHERE p.s1_id = i.s1_id) AS n_pred, (SELECT count(*) FROM truth t WHERE t.s1_id = i.s1_id) AS n_true, (SELECT count(*) FROM matched p JOIN truth t USING (s1_id, cand_id) WHERE p.s1_id = i.s1_id) AS tp FROM idx i) GROUP BY country", "idx", "matched", "truth")

# Windows, order, samples, sets.
_over("win_rank_topk", "SELECT s1_id, cand_id, k FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) - 1 AS k FROM {scored}) x WHERE k < 5", "scored", plan=lambda s: tables.ranked(s, "s1_id", F.desc("prob"), F.col("cand_id"), k=5).select("s1_id", "cand_id", "k"))
_query("win_block_cap", lambda s, d: blocking.first_of_key(E.sides(s, d)[1].select("entity_id", "country", "nname"), ["country", "nname"], 2), "SELECT entity_id, country, nname FROM (SELECT entity_id, country, nname, row_number() OVER (PARTITION BY country, nname ORDER BY entity_id) AS k FROM ent WHERE src > 1) x WHERE k <= 2", "ent")
_query("win_token_cap", lambda s, d: E.entities(s, d).select("entity_id", F.array_join(F.slice(T.digit_tokens(F.col("naddr")), 1, 6), " ").alias("digits")), "SELECT entity_id, array_to_string(digits[1:6], ' ') AS digits FROM prep", "prep")
QUERIES["win_heap_cap"] = lambda s, d: blocking.multi_token(*E.sides(s, d), cap=5)
ORACLE_SQL["win_heap_cap"] = ORACLE_SQL["join_multi_token_overlap"].replace("WHERE rank < 150", "WHERE rank < 5")
_over("win_transform_size", "SELECT s1_id, cand_id, count(*) OVER (PARTITION BY s1_id) AS n_cands FROM {cand}", "cand", plan=lambda c: tables.group_size(c.select("s1_id", "cand_id"), "s1_id", "n_cands"))
_query("win_avg_rank_auc", lambda s, d: decide.average_ranks(QUERIES["join_label_left"](s, d)).select("prob", "n", "rank"), "SELECT prob, count(*) AS n, any_value(rank) AS rank FROM (SELECT prob, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS rank FROM scored) GROUP BY prob", "scored")
_over("win_prefix_scan", "SELECT s1_id, cand_id, round(sum(prob) OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id ROWS UNBOUNDED PRECEDING), 5) AS running FROM {scored}", "scored", plan=lambda s: tables.running_sum(s, "s1_id", "prob", F.desc("prob"), F.col("cand_id")).select("s1_id", "cand_id", F.round("running", 5).alias("running")))
_query("win_cumsum_offsets", lambda s, d: decide.running_offsets(E.index(s, d)), "SELECT s1_id, CAST(sum(n_cands) OVER (PARTITION BY country ORDER BY s1_id ROWS UNBOUNDED PRECEDING) - n_cands AS BIGINT) AS first_row FROM idx", "idx")
_over("sort_result_rows", "SELECT source1_entity_id, matched_entity_ids FROM {lists} ORDER BY source1_entity_id", "lists", plan=lambda x: x.select("source1_entity_id", "matched_entity_ids").orderBy("source1_entity_id"))
_query("argmax_row", lambda s, d: decide.sweep(E.index(s, d), E.scored(s, d), E.truth(s, d), _GRID).orderBy(F.desc("macro_f05"), "threshold").limit(1), ORACLE_SQL["sweep_threshold"] + " ORDER BY macro_f05 DESC, threshold LIMIT 1")
_over("sample_rows", "SELECT entity_id FROM {ent} WHERE substring(md5(entity_id), 1, 1) = '7'", "ent", plan=lambda e: e.filter(F.md5("entity_id").startswith("7")).select("entity_id"))
_query("shuffle_split", lambda s, d: QUERIES["shard_of"](s, d).select("entity_id", F.when(F.col("bucket") < 56, "train").when(F.col("bucket") < 70, "calibrate").otherwise("validate").alias("part")), "SELECT entity_id, CASE WHEN bucket < 56 THEN 'train' WHEN bucket < 70 THEN 'calibrate' ELSE 'validate' END AS part FROM (" + ORACLE_SQL["shard_of"] + ")")
_over("union_all", "SELECT entity_id, country FROM {ent} WHERE src = 2 UNION ALL SELECT entity_id, country FROM {ent} WHERE src = 3", "ent", plan=lambda e: e.filter("src = 2").unionByName(e.filter("src = 3")).select("entity_id", "country"))

# Scalar functions, over whole texts or the entity view.
_text = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
_TEXT = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_squeeze = lambda e, keep="": f"trim(regexp_replace(regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_\\s{keep}]', ' ', 'g'), '\\s+', ' ', 'g'))"
_INDIC = "प्राइवेट। शर्मा"  # the texts have no Indic letters of their own
#: Letters and marks that the tables lack: one and several marks, decomposed forms, letters without a mark of their own.
_LETTERS = "Žižek Ő Şirket Āć Ǻ Ṩ Cafe\u0301s ǰ łø ĐđŒ"
_md5 = lambda c: F.md5(c.cast("binary"))
_query("strip_latin_accents", lambda s, d: _text(s, d).select("doc_id", _md5(T.strip_accents(F.col("t"))).alias("plain")), f"SELECT doc_id, md5(strip_accents(t)) AS plain FROM {_TEXT}")
_query("norm_v1", lambda s, d: _text(s, d).select("doc_id", _md5(T.norm_blocking(F.concat("t", F.lit(" " + _LETTERS)))).alias("norm")), "SELECT doc_id, md5(" + _squeeze(f"strip_accents(lower(t || ' {_LETTERS}'))") + f") AS norm FROM {_TEXT}")
_query("norm_v2", lambda s, d: _text(s, d).select("doc_id", _md5(T.norm_blocking(F.concat("t", F.lit(_INDIC)), keep_marks=True)).alias("norm")),
       "SELECT doc_id, md5(" + _squeeze(f"regexp_replace(strip_accents(lower(t)) || '{_INDIC}', '[\\x{{0964}}\\x{{0965}}]', ' ', 'g')", "\\x{0900}-\\x{0D7F}") + f") AS norm FROM {_TEXT}")
_query("norm_feature", lambda s, d: _text(s, d).select("doc_id", _md5(T.norm_feature(F.col("t"))).alias("norm")), f"SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(t)), '[^a-z0-9\\x{{0900}}-\\x{{0D7F}}]+', ' ', 'g'))) AS norm FROM {_TEXT}")
_ent = lambda name, column, sql, *needs: _query(name, lambda s, d: E.entities(s, d).select("entity_id", column().alias(name)), f"SELECT entity_id, {sql} AS {name} FROM {needs[0] if needs else 'ent'}", needs[0] if needs else "ent")
_joined = lambda c: F.array_join(c, " ")
_ent("core_tokens", lambda: _joined(T.core_tokens(F.col("nname"))), "array_to_string(core, ' ')", "prep")
_ent("squash", lambda: T.squash(F.col("nname")), "squash", "prep")
_ent("digit_tokens", lambda: _joined(T.digit_tokens(F.col("naddr"))), "array_to_string(digits, ' ')", "prep")
_ent("locality_tokens", lambda: _joined(T.locality_tokens(F.col("naddr"))), f"array_to_string(list_filter({_toks('naddr')}, lambda x: regexp_full_match(x, '\\p{{L}}+'))[-3:], ' ')")
_ent("char_3grams", lambda: _joined(F.array_sort(T.char_grams(F.col("nname")))), f"array_to_string(list_sort({_grams('nname')}), ' ')")
_pin = lambda: F.concat("naddr", F.lit(" 12345 "), F.lpad(F.substring_index("entity_id", "-", -1), 6, "0"), F.lit(" x"))
_query("pincode", lambda s, d: E.entities(s, d).select("entity_id", T.pincode(_pin(), F.when(F.col("src") == 2, "India").otherwise(F.col("country"))).alias("pincode")), f"SELECT entity_id, coalesce(list_filter({_toks('a')}, lambda t: regexp_full_match(t, CASE WHEN src = 2 THEN '[0-9]{{6}}' ELSE '[0-9]{{5}}' END))[-1], '') AS pincode FROM (SELECT entity_id, src, naddr || ' 12345 ' || lpad(split_part(entity_id, '-', 2), 6, '0') || ' x' AS a FROM ent)", "ent")
_ent("acronym", lambda: T.acronym(F.col("nname")), "array_to_string(list_transform(core, lambda x: x[1]), '')", "prep")
_query("domain_name", lambda s, d: _text(s, d).select("doc_id", T.is_domain_name(F.col("t")).alias("domain")), f"SELECT doc_id, regexp_matches(t, '(?i)\\.(com|net|org|in)\\b') AS domain FROM {_TEXT}")
_query("indic_flag", lambda s, d: _text(s, d).select("doc_id", T.is_indic(F.when(F.col("doc_id") % 2 == 0, F.concat("t", F.lit(_INDIC))).otherwise(F.col("t"))).alias("indic")), f"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 2 = 0 THEN t || '{_INDIC}' ELSE t END, '[\\x{{0900}}-\\x{{0D7F}}]') AS indic FROM {_TEXT}")
_query("split_tokens", lambda s, d: E.entities(s, d).select("entity_id", F.explode(T.tokens(F.col("nname"))).alias("token")).groupBy("entity_id", "token").agg(F.count("*").alias("n")), f"SELECT entity_id, token, count(*) AS n FROM (SELECT entity_id, unnest({_toks('nname')}) AS token FROM ent) GROUP BY ALL", "ent")
_query("split_id_list", lambda s, d: E.lists(s, d).select(F.col("source1_entity_id").alias("s1_id"), F.when(F.col("matched_entity_ids") == "", F.lit(0)).otherwise(F.size(F.split("matched_entity_ids", ","))).alias("n")), "SELECT source1_entity_id AS s1_id, len(CASE WHEN matched_entity_ids = '' THEN [] ELSE string_split(matched_entity_ids, ',') END)::INT AS n FROM lists", "lists")
# No SQL: transliteration and difflib's ratio are Python's; tests compare them with plain functions.
_indic_name = lambda: F.concat("nname", F.lit(" " + _INDIC))
QUERIES["translit_view"] = lambda s, d: E.entities(s, d).select("entity_id", F.when(T.is_indic(_indic_name()), T.transliterate(_indic_name())).otherwise(F.col("nname")).alias("view"))
QUERIES["translit_naive"] = lambda s, d: E.entities(s, d).select("entity_id", T.transliterate(_indic_name()).alias("view"))
QUERIES["translit_clean"] = lambda s, d: E.entities(s, d).select("entity_id", T.collapse_repeats(T.transliterate(_indic_name())).alias("view"))
QUERIES["sequence_ratio"] = lambda s, d: QUERIES["join_attr_left"](s, d).select("s1_id", "cand_id", T.sequence_ratio(F.col("s1_name"), F.col("cand_name")).alias("ratio")).withColumn("severe_typo", F.col("ratio") > 0.6)

# Models, metrics, checks.
_query("vectorize_tfidf", lambda s, d: (lambda q, c: q.unionByName(c).select("entity_id", "token", F.round("w", 6).alias("w")))(*blocking.weights(*E.sides(s, d), blocking.words(F.concat("nname", F.lit(" "), "naddr")))), "SELECT entity_id, token, round(w, 6) AS w FROM w_word", "w_word")
_query("metric_pr_auc", lambda s, d: decide.average_precision(QUERIES["join_label_left"](s, d)), f"SELECT round(sum(pos / total * up_pos / up_n), 6) AS average_precision FROM (SELECT pos, sum(pos) OVER () AS total, sum(pos) OVER (ORDER BY prob DESC) AS up_pos, sum(n) OVER (ORDER BY prob DESC) AS up_n FROM (SELECT prob, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM ({_LABEL.format(scored='scored', truth='truth')}) GROUP BY prob))", "scored", "truth")
_PER_S1 = "SELECT i.s1_id, count(p.cand_id) AS n_pred, count(CASE WHEN p.cand_id IS NOT NULL AND t.cand_id IS NOT NULL THEN 1 END) AS tp, any_value(coalesce(k.n, 0)) AS n_true FROM idx i LEFT JOIN matched p ON p.s1_id = i.s1_id LEFT JOIN truth t ON t.s1_id = p.s1_id AND t.cand_id = p.cand_id LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1) k ON k.s1_id = i.s1_id GROUP BY i.s1_id"
_query("metric_f05_stats", lambda s, d: decide.f05_stats(E.index(s, d), _INPUT["matched"](s, d), E.truth(s, d)), f"""SELECT sum(n_pred)::BIGINT AS n_pred, sum(tp)::BIGINT AS tp, (sum(n_pred) - sum(tp))::BIGINT AS fp, (sum(n_true) - sum(tp))::BIGINT AS fn, round(sum(tp) / greatest(sum(n_pred), 1), 6) AS precision, round(sum(tp) / greatest(sum(n_true), 1), 6) AS recall,
  round(avg(CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * tp / n_pred + tp / n_true) END), 6) AS macro_f05, round(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT END), 6) AS singleton_accuracy FROM ({_PER_S1})""", "idx", "matched", "truth")
_SIGNAL = [f for f in _FEATS if f not in ("indic_script", "country_india", "n_cands", "cand_addr_ntok")]
_FL = "SELECT f.*, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM {feat} f LEFT JOIN {truth} t ON t.s1_id = f.s1_id AND t.cand_id = f.cand_id"
_over("_feature_labels", _FL, "feat", "truth", plan=tables.labelled)
_feature_labels = QUERIES.pop("_feature_labels")
del ORACLE_SQL["_feature_labels"]
_query("feature_signal_table", lambda s, d: decide.feature_signal(_feature_labels(s, d), _SIGNAL), f"""SELECT feature, round((sum(rank) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 4) AS auc, round(avg(value) FILTER (WHERE label = 1), 4) AS pos_mean, round(avg(value) FILTER (WHERE label = 0), 4) AS neg_mean,
  round(avg(label) FILTER (WHERE value >= 0.9), 4) AS precision_high, round(avg((value >= 0.9)::INT), 4) AS coverage_high FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rank FROM (SELECT feature, label, round(value::FLOAT::DOUBLE, 4) AS value FROM (
    UNPIVOT (SELECT label, {', '.join(f'{f}::FLOAT::DOUBLE AS {f}' for f in _SIGNAL)} FROM ({_FL.format(feat='feat', truth='truth')})) ON {', '.join(_SIGNAL)} INTO NAME feature VALUE value))) GROUP BY feature""", "feat", "truth")
_CH = {"new_fp": "o AND NOT b AND NOT t", "fixed_fp": "b AND NOT o AND NOT t", "new_tp": "o AND NOT b AND t", "lost_tp": "b AND NOT o AND t"}
_query("compare_models", lambda s, d: decide.compare(E.scored(s, d).filter("prob >= 0.625"), _INPUT["matched"](s, d), E.truth(s, d)), " UNION ALL ".join(f"SELECT '{n}' AS change, count(*) FILTER (WHERE {e}) AS n FROM (SELECT s.prob >= 0.625 AS b, m.s1_id IS NOT NULL AS o, t.s1_id IS NOT NULL AS t FROM scored s LEFT JOIN matched m ON m.s1_id = s.s1_id AND m.cand_id = s.cand_id LEFT JOIN truth t ON t.s1_id = s.s1_id AND t.cand_id = s.cand_id)" for n, e in _CH.items()), "scored", "matched", "truth")
# Prediction of all rows in parts, each written on its own, as a scorer that is started again would find them.
def _predicted_parts(s: SparkSession, d: str, path: str) -> None:
    model, rows = _trained(s, d)
    learn.predict(model, rows).select("s1_id", "cand_id", "prob", T.shard_of(F.col("s1_id"), 3).alias("part")).write.partitionBy("part").parquet(path)


QUERIES["predict_chunks"] = _again("predicted", _predicted_parts)
_query("logreg_baseline", lambda s, d: (lambda r: learn.predict(learn.train_logistic(r.filter("fold = 'train'")), r.filter("fold = 'validate'")).select("s1_id", "cand_id", "label", "prob"))(_trained(s, d)[1]))
_WRONG = ["s1_id", "cand_id", features.MODEL_FEATURES[1], features.MODEL_FEATURES[0], *features.MODEL_FEATURES[3:]]
_query("check_feature_order", lambda s, d: s.createDataFrame(validate.check_feature_order(_WRONG, list(features.MODEL_FEATURES)), "rule string, column string"), "SELECT unnest(['missing_feature', 'out_of_order', 'out_of_order']) AS rule, unnest(['addr_lev', 'addr_3gram_jac', 'addr_tok_cont']) AS column")
_query("check_duplicate_pairs", lambda s, d: validate.duplicate_pairs((lambda c: c.unionByName(c.filter("channels >= 4")))(E.candidates(s, d).select("s1_id", "cand_id", "channels"))), "SELECT s1_id, cand_id, count(*) AS n FROM (SELECT s1_id, cand_id FROM cand UNION ALL SELECT s1_id, cand_id FROM cand WHERE channels >= 4) GROUP BY ALL HAVING count(*) > 1", "cand")
_query("check_cross_file_s1", lambda s, d: validate.in_several_parts(_again("by_source", lambda s, d, p: files.write_parts(E.candidates(s, d).select("s1_id", F.substring("cand_id", 1, 2).alias("source")), p, "source"))(s, d).select("s1_id", F.regexp_extract(F.input_file_name(), "source=(S[0-9])", 1).alias("part"))), "SELECT s1_id, n_parts FROM (SELECT s1_id, count(DISTINCT substring(cand_id, 1, 2)) AS n_parts FROM cand GROUP BY s1_id) x WHERE n_parts > 1", "cand")
_query("check_finite", lambda s, d: validate.not_finite(E.pair_features(s, d), _FEATS), f"SELECT unnest([{', '.join(repr(f) for f in _FEATS)}]) AS feature, unnest([{', '.join(f'(SELECT count(*) FROM feat WHERE {f} IS NULL OR NOT isfinite({f}))' for f in _FEATS)}]) AS n", "feat")
_query("normalization_audit", lambda s, d: _text(s, d).select(T.norm_blocking(F.col("t")).alias("once")).withColumn("again", T.norm_blocking(F.col("once"))).agg(F.count("*").alias("n"), F.count_if(F.col("once") == F.col("again")).alias("idempotent"), F.count_if(F.col("once") == "").alias("empty"), F.count_if(F.col("once").contains("  ")).alias("double_blanks")),
       f"SELECT count(*) AS n, count_if(norm = {_squeeze('strip_accents(lower(norm))')}) AS idempotent, count_if(norm = '') AS empty, count_if(contains(norm, '  ')) AS double_blanks FROM norm", "norm")

# Retrieval study: recall and mean number of candidates of each method alone and of unions with budgets.
_METHODS = {"M1_exact_name": "SELECT s1_id, cand_id FROM exact", "M2_word_10": "SELECT s1_id, cand_id FROM top_word WHERE rank < 10", "M3_word_100": "SELECT s1_id, cand_id FROM top_word", "M4_char_10": "SELECT s1_id, cand_id FROM top_char WHERE rank < 10", "M5_char_100": "SELECT s1_id, cand_id FROM top_char", "M6_rare_token": "SELECT s1_id, cand_id FROM rare", "M7_word_and_char": "SELECT s1_id, cand_id FROM top_word INTERSECT SELECT s1_id, cand_id FROM top_char",
            "M8_word_or_exact": "SELECT s1_id, cand_id FROM top_word UNION SELECT s1_id, cand_id FROM exact", "M9_all": "SELECT s1_id, cand_id FROM cand", "M10_rare_or_exact": "SELECT s1_id, cand_id FROM rare UNION SELECT s1_id, cand_id FROM exact", "R1_budget_3": "SELECT s1_id, cand_id FROM cand WHERE word_rank BETWEEN 0 AND 2 OR char_rank BETWEEN 0 AND 2 OR channels >= 4", "R2_budget_1": "SELECT s1_id, cand_id FROM cand WHERE word_rank = 0 OR char_rank = 0"}


def _studied(s: SparkSession, d: str) -> DataFrame:
    two = lambda f: f.select("s1_id", "cand_id")
    word, char, cand, rare = E.word_channel(s, d), E.char_channel(s, d), E.candidates(s, d), _INPUT["rare"](s, d)
    exact = blocking.exact_block(*E.sides(s, d))
    found = (exact, word.filter("rank < 10"), word, char.filter("rank < 10"), char, rare, word.join(char, ["s1_id", "cand_id"], "left_semi"), two(word).unionByName(two(exact)).distinct(), cand, two(rare).unionByName(two(exact)).distinct(), blocking.budgeted(cand, {}, (3, 3)), cand.filter("word_rank = 0 or char_rank = 0"))
    every = None
    for name, f in zip(_METHODS, found, strict=True):
        f = two(f).withColumn("method", F.lit(name))
        every = f if every is None else every.unionByName(f)
    return decide.study(every, E.truth(s, d), E.sides(s, d)[0])


_query("study_methods", _studied, " UNION ALL ".join(f"SELECT '{n}' AS method, count(*) AS pairs, round((SELECT count(*) FROM ({q}) JOIN truth USING (s1_id, cand_id)) / (SELECT count(*) FROM truth), 6) AS recall, round(count(*) / (SELECT count(*) FROM ent WHERE src = 1), 6) AS mean_candidates FROM ({q})" for n, q in _METHODS.items()), "exact", "top_word", "top_char", "rare", "cand", "truth", "ent")
