"""URL filters: host and path rules, then a list behind a blocked Bloom filter, in DataFrame functions only.

A canonical URL is the host without a leading www., the path without a final slash, and the query without tracking
parameters; scheme and fragment go. The filter of the listed ones is a bounded table of blocks (bloom.py). URLs that
pass it go on to an exact join with the list, which removes false positives. Rules come first, the longest that fits;
the list decides for URLs without one.

Cases: a null URL or one without :// has an empty host and path, fits no rule and is never listed; repeated pages each
get a row; an empty list blocks nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import bloom
from quaystone.llm.common import cut, salted_join, table

#: (verdict, host, path), from the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: What marks a page's text as junk, for the list of the registered query.
JUNK = "###|%%%|[$]{3}|[*]{3}"


def host_and_path(url: str) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def canonical(url: str) -> Column:
    """null where there is no host."""
    host, path = host_and_path(url)
    query = F.array_join(F.filter(F.split(F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit("")), "&"), lambda p: ~p.rlike(TRACKING) & (p != "")), "&")
    text = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", text)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict, a row per page; listed: a column canonical of URLs to block."""
    listed = cut(listed.where(F.col("canonical").isNotNull()).select("canonical").distinct())
    filters, blocks = bloom.build(listed, "canonical")
    host, path = host_and_path("url")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    keyed = judged.withColumn("canonical", F.when(F.col("rule").isNull(), canonical("url"))).drop("url")
    asked = bloom.probed(keyed, "canonical", filters, blocks, keep_all=True)
    columns = ["page_id", "host", "path", "rule", "by_rule"]
    # pages of one URL are dealt into parts, so a URL with many pages is no task's alone
    hits = salted_join(asked.where("possible"), listed.withColumn("hit", F.lit("block")), ["canonical"], "page_id", "left").select(*columns, "hit")
    rest = asked.where("not possible").select(*columns, F.lit(None).cast("string").alias("hit"))
    return hits.union(rest).select("page_id", "host", "path", "rule", F.coalesce("by_rule", "hit", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists the canonical URLs of pages whose text is marked as junk."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, pages.where(F.col("html").rlike(JUNK)).select(canonical("url").alias("canonical")))


_CASE = lambda i: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, k)[i]}'" for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
SQL = {
    "op5_url_filter": rf"""
WITH u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path, coalesce(regexp_extract(url, '{PARTS}', 3), '') AS query FROM pages),
q AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')), '&') AS kept FROM u),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM q),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(html, '{JUNK}') AND canonical IS NOT NULL)
SELECT page_id, host, path, {_CASE(0)} AS rule,
  coalesce({_CASE(1)}, CASE WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM c
"""
}
QUERIES = {"op5_url_filter": op5_url_filter}
