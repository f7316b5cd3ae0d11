"""Op 2: URL rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col

#: Blocks of 256 bits in the filter; at most as many rows of 36 bytes are broadcast, whatever the list.
FILTER_BLOCKS = 1 << 14
BITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a trailing slash, query without utm_ and ref parameters; no scheme, no fragment. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1), F.lit("")), r"(^|&)(utm_[^=&]*|ref)(=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, r"^&", "")
    path = F.regexp_replace(path_of(url), r"/$", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; ``rules`` are (verdict, host/path) from the caller."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def bloom_words(key: Column) -> tuple[Column, list[Column]]:
    """The block of a key and its bits there, as four longs."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    place = [F.shiftright(g, 8 * i).bitwiseAND(F.lit(255)) for i in range(BITS)]
    one = F.lit(1).cast("long")
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for p in place:
            word = word.bitwiseOR(F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", one, p.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.pmod(h, F.lit(FILTER_BLOCKS)).cast("int"), words


def bloom_filter(listed: DataFrame, key: str) -> DataFrame:
    """block, w0 .. w3: the used blocks of the filter."""
    block, words = bloom_words(F.col(key))
    return listed.select(block.alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict of every row: the longest fitting rule's verdict, else block for listed URLs and allow for others.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and are never listed. Canonical forms
    are compared. URLs that a rule doesn't decide ask the Bloom filter; the few that pass meet the list in an exact join
    on the canonical URL, both sides counted once a URL beforehand, so a URL of many pages stays one key. Equal rows and
    ids each give a row; an empty list blocks nothing; other columns are ignored.
    """
    url = col(url_col).cast("string")
    df = pages.select(col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.select("*", text.alias("rule"), verdict.alias("ruled"))
    wanted = listed.select(canonical(col(listed_col).cast("string")).alias("wanted")).where("wanted is not null").distinct()
    block, words = bloom_words(F.col("key"))
    bloom = F.broadcast(bloom_filter(wanted, "wanted"))
    open_ = df.where(F.col("ruled").isNull() & F.col("key").isNotNull()).select("key").distinct()
    probe = open_.select("key", block.alias("at"), *(w.alias(f"p{i}") for i, w in enumerate(words))).join(bloom, F.col("at") == F.col("block"))
    for i in range(4):
        probe = probe.where(F.col(f"w{i}").bitwiseAND(F.col(f"p{i}")) == F.col(f"p{i}"))
    sure = probe.select("key").join(wanted, F.col("key") == F.col("wanted"), "left_semi").select(F.col("key").alias("listed"))
    # rows that ask nothing get keys of their own, so that they don't meet in one task
    apart = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    df = df.withColumn("asks", F.coalesce(F.when(F.col("ruled").isNull(), F.col("key")), apart))
    out = df.join(sure, F.col("asks") == F.col("listed"), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed").isNotNull(), "block").otherwise("allow")).alias("verdict"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Host words of sites whose URLs the query lists.
SPAM = "spam|pills|bets|casino|viagra"

_CANON = r"""CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/$', '') ||
  CASE WHEN q <> '' THEN '?' || q ELSE '' END END"""
OP2_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         regexp_replace(array_to_string(list_filter(string_split(coalesce(regexp_extract(url, '^[^#?]*\?([^#]*)', 1, 's'), ''), '&'), lambda x: NOT regexp_full_match(x, '(utm_[^=&]*|ref)(=[^&]*)?')), '&'), '^&', '') AS q
  FROM pages
), c AS (SELECT *, {_CANON} AS key FROM p
), listed AS (SELECT DISTINCT key FROM c WHERE regexp_matches(host, '{SPAM}') AND key IS NOT NULL
), r(rule, verdict, h, s) AS (VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), u AS (
  SELECT page_id, host, path, key, (SELECT max_by(rule, length(rule)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS rule FROM c
)
SELECT page_id, host, path, u.rule, coalesce(r.verdict, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN r ON u.rule = r.rule LEFT JOIN listed ON u.key = listed.key
"""
