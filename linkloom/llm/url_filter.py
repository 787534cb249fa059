"""URL filter with redirect equivalence.

Rules (host, path, verdict) fit a host with all its subdomains where the path starts with the rule's;
the longest wins. Pages tie their own address to the targets of their canonical link and of their
refresh redirect (and of a given table of redirects). Addresses that are tied, over any number of
steps, are aliases: a block of one blocks all, also where the blocked address is no page itself. An
explicit allow has precedence for the addresses that its rule fits.

An address is the host in lower case, without a default port, and the path with its query; scheme and
fragment make no difference. Components are found by distributed rounds (``components``); nothing is
done for them where no page ties any addresses.

Defined cases: null urls, and those without ``://``, have an empty host and path, fit no rule and are
no aliases; empty targets tie nothing; html of any length is read whole, its first canonical link and
first refresh count; repeated rows give repeated rows; rules of one length can't both
fit one url unless they are equal, then the first given wins; an empty table gives an empty table; only
``page_id``, ``url`` and ``html`` are read, so clashing names of other columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

#: Host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
CANONICAL = r"""(?i)<link\b[^<>]*\brel\s*=\s*["']?canonical\b[^<>]*>"""
REFRESH = r"""(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b[^<>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'<>\s]+)"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'<>\s]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, C.UPPER, C.UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """Null where there is no host."""
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct of the rule's text and verdict, null where none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _absolute(target: Column, url: Column) -> Column:
    here = F.concat(F.lit("http://"), host_of(url))
    return (F.when((target == "") | (host_of(url) == ""), None).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("/"), F.concat(here, target)).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(F.concat(here, F.regexp_replace(path_of(url), r"[^/]*$", ""), target)))


def ties(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from pages' addresses to those of their canonical links and refresh redirects."""
    html = F.coalesce("html", F.lit(""))
    targets = F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1))
    some = pages.filter(html.rlike(r"(?i)canonical|refresh")).select("url", F.explode(targets).alias("target"))
    return some.select(address_of(F.col("url")).alias("a"), address_of(_absolute(F.replace("target", F.lit("&amp;"), F.lit("&")), F.col("url"))).alias("b")).filter("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict``; ``redirects`` has further urls (from_url, to_url)."""
    edges = ties(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address_of(F.col("from_url")).alias("a"), address_of(F.col("to_url")).alias("b")))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address_of(F.col("url")).alias("node"))
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    labels = connected_components(edges)
    url = F.concat(F.lit("http://"), F.col("node"))
    blocked = labels.filter(rule_of(host_of(url), path_of(url), rules)["verdict"] == "block").select("label").distinct()
    aliases = labels.join(blocked, "label", "left_semi").select("node", F.lit(True).alias("alias_blocked"))
    judged = own.join(aliases, "node", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("alias_blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages"))
