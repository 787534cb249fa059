"""DuckDB SQL for the queries that SQL can express; see ``entry.py`` for which have none, and why."""

CHAT = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         length('### ' || replace(replace(replace(replace(role, '\\', '\\b'), '#', '\\h'), '<', '\\l'), ':', '\\c') || ': '
           || replace(replace(replace(text, '\\', '\\b'), '#', '\\h'), '<', '\\l') || '</turn>' || chr(10)) AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (WHERE role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

DECONTAMINATION = """
WITH words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
widths AS (SELECT DISTINCT least(5, len(w)) AS width FROM words WHERE side = 1 AND len(w) > 0),
shingles AS (
  SELECT DISTINCT side, id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS s
  FROM words JOIN widths ON side = 0 AND len(w) >= width OR side = 1 AND width = least(5, len(w))),
items AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 1)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::BIGINT AS n_shared, any_value(i.n)::BIGINT AS n_item,
       count(*)::DOUBLE / any_value(i.n) AS containment
FROM items i JOIN (SELECT * FROM shingles WHERE side = 0) d USING (width, s)
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(i.n)
"""


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(host: str, path: str, column: int) -> str:
    from .url_filter import RULES

    cases = " ".join(f"WHEN ({host} = '{r[0]}' OR ends_with({host}, '.{r[0]}')) AND starts_with({path}, '{r[1]}') THEN '{(r[0] + r[1], r[2])[column]}'" for r in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    return f"CASE {cases} END"


def _host(url: str) -> str:
    return _lower(f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1)")


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _address(url: str) -> str:
    host, rest = f"regexp_replace({_host(url)}, ':(80|443)?$', '')", f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END END"


def urls() -> str:
    canonical = r"""(?i)<link\b[^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*>"""
    refresh = r"""(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^<>]*>"""
    href, target = r"""(?i)\bhref\s*=\s*["'']?([^"''<>\s]+)""", r"""(?i)\burl\s*=\s*["'']?([^"''<>\s]+)"""
    here = f"'http://' || {_host('url')}"
    absolute = f"CASE WHEN t = '' OR {_host('url')} = '' THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN {here} || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE {here} || regexp_replace({_path('url')}, '[^/]*$', '') || t END"
    return f"""
WITH RECURSIVE targets AS (
  SELECT url, replace(regexp_extract(regexp_extract(coalesce(html, ''), '{canonical}'), '{href}', 1), '&amp;', '&') AS t FROM pages
  UNION ALL SELECT url, replace(regexp_extract(regexp_extract(coalesce(html, ''), '{refresh}'), '{target}', 1), '&amp;', '&') FROM pages),
full_targets AS (SELECT url, {absolute} AS t FROM targets),
ties AS (SELECT {_address('url')} AS a, {_address('t')} AS b FROM full_targets WHERE t IS NOT NULL),
edges AS (SELECT a, b FROM ties WHERE a <> b UNION SELECT b, a FROM ties WHERE a <> b),
blocked AS (
  SELECT DISTINCT a AS node FROM edges WHERE {_rule(_host("('http://' || a)"), _path("('http://' || a)"), 1)} = 'block'
  UNION SELECT e.b FROM blocked JOIN edges e ON e.a = blocked.node)
SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_rule(_host('url'), _path('url'), 0)} AS rule,
       coalesce({_rule(_host('url'), _path('url'), 1)}, CASE WHEN {_address('url')} IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages
"""


def mixing() -> str:
    from .mixing import OTHER, POWERS, ROUNDS, SHARE, TOPICS

    topic = "CASE " + " ".join(f"WHEN list_has_any(w, [{', '.join(repr(m) for m in marks)}]) THEN '{name}'" for name, marks in TOPICS.items()) + f" ELSE '{OTHER}' END"
    steps, last = [], "cells"
    for margin, power in POWERS.items():
        scaled = f"pow(own_{margin}::DOUBLE, {power})"
        steps.append(f"a_{margin} AS (SELECT *, sum(tokens) OVER (PARTITION BY {margin}) AS own_{margin}, count(*) OVER (PARTITION BY {margin}) AS n_{margin} FROM {last})")
        steps.append(f"b_{margin} AS (SELECT *, CASE WHEN own_{margin} > 0 THEN {SHARE} * total * {scaled} / sum({scaled} / n_{margin}) OVER () ELSE 0 END AS to_{margin} FROM a_{margin})")
        last = f"b_{margin}"
    steps.append(f"r0 AS (SELECT *, {SHARE}::DOUBLE AS p FROM {last})")
    last, k = "r0", 0
    for r in range(ROUNDS):
        for j, margin in enumerate(POWERS):
            k += 1
            now = f"sum(p * tokens) OVER (PARTITION BY {margin})"
            p = f"CASE WHEN {now} > 0 THEN p * to_{margin} / {now} ELSE p END"
            steps.append(f"r{k} AS (SELECT * EXCLUDE (p), {f'least({p}, 1.0)' if j == len(POWERS) - 1 else p} AS p FROM {last})")
            last = f"r{k}"
    return f"""
WITH d AS (SELECT doc_id, source, lang, string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') AS w FROM documents),
described AS (SELECT doc_id, source, lang, {topic} AS topic, len(list_filter(w, lambda x: x <> ''))::BIGINT AS n_tokens FROM d),
sums AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM described GROUP BY ALL),
cells AS (SELECT *, sum(tokens) OVER () AS total FROM sums),
{', '.join(steps)},
rates AS (SELECT source, lang, topic, round(p, 9) AS probability FROM {last})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || n_tokens), 1, 13))::BIGINT::DOUBLE / 4503599627370496 < probability AS kept
FROM described d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic IS NOT DISTINCT FROM r.topic
"""
