"""URL filters, with DataFrame operations only: rules by host and path, and a list of exact URLs.

The listed URLs, made canonical, fill a blocked Bloom filter: each URL sets eight
bits, one in each 64-bit word of one block.  Only pages whose bits are all set go
to the exact join with the list, which removes the false positives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a block, and so bits set for each URL.
WORDS = 8
#: Most blocks of a filter: 2^18 blocks of 64 bytes are 16 MB, what may be broadcast at most.
#: Longer lists get more false positives, which only the exact join sees.
MAX_BLOCKS = 1 << 18
#: Listed URLs a block is made for: about 21 bits each.
URLS_A_BLOCK = 24


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of the path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of op10 (fixed values).
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.when(F.octet_length(host) == F.char_length(host), F.lower(host)).otherwise(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.``, path without slashes at its end, and the query without
    ``utm_`` parameters; scheme and fragment are dropped.  Null if there is no host."""
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    plain = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host_of(url) != "", plain)


def _rule_order(rules) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.text), r.text))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones the smallest text); else null.

    ``rules`` are a program's short list: they become one expression.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(_rule_order(rules)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit for each word, from six bits each of a second hash."""
    second = F.xxhash64(F.lit(7), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """``(block, w0 ... w7)`` for the blocks that have a bit set, by a map-side combined aggregate."""
    key = F.col(url_col)
    rows = listed.where(key.isNotNull()).select(_block(key, blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", rules=RULES, blocks: int | None = None) -> DataFrame:
    """``id_col, host, path, rule, verdict, listed`` for every row of ``pages``.

    A rule's verdict wins over the list; without a rule, listed URLs are blocked and all
    others allowed.  Null URLs and URLs without ``://`` have empty host and path, fit no rule,
    are never listed and are allowed.  Rows that repeat stay; an empty list blocks nothing; an
    empty table gives an empty one; other columns are not read.
    """
    urls = listed.select(canonical(F.col(listed_col).cast("string")).alias("listed_url")).where("listed_url IS NOT NULL").distinct()
    if blocks is None:
        blocks = min(MAX_BLOCKS, max(16, 1 << math.ceil(math.log2(max(1, urls.count() / URLS_A_BLOCK)))))
    bloom = bloom_filter(urls, "listed_url", min(blocks, MAX_BLOCKS))
    url = F.col("url")
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "ruled": verdict, "block": F.coalesce(_block(F.col("key"), blocks), F.lit(-1))})
    # At most MAX_BLOCKS rows of 68 bytes.
    probed = judged.join(F.broadcast(bloom), "block", "left")
    possible = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        possible = possible & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    probed = probed.withColumn("possible", F.coalesce(possible, F.lit(False)))
    out = ["id", "host", "path", "rule", "ruled"]
    # Pages that the filter clears skip the join; the rest are joined with the list, each URL of which is there once.
    clear = probed.where(~F.col("possible")).select(*out, F.lit(False).alias("listed"))
    held = probed.where("possible").join(urls, F.col("key") == F.col("listed_url"), "left").select(*out, F.col("listed_url").isNotNull().alias("listed"))
    return clear.unionByName(held).select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: Names in hosts whose pages the query's list is made of (fixed values).
LISTED_HOSTS = r"(^|\.)(adult|casino|spam)-"


def op10_url_filter(spark, sf_dir) -> DataFrame:
    """The list is every URL of ``pages`` on hosts named as adult, casino or spam sites."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, pages.where(host_of(F.col("url")).rlike(LISTED_HOSTS)))


OP10_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '^[^#?]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM pages
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM parts
), rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), listed AS (
  SELECT DISTINCT key FROM keyed WHERE regexp_matches(host, '(^|\.)(adult|casino|spam)-')
), judged AS (
  SELECT k.page_id, k.host, k.path, k.key IN (SELECT key FROM listed) AS listed,
    (SELECT arg_min(r.host || r.path, -length(r.host || r.path)) FROM rules r
      WHERE (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)) AS rule
  FROM keyed k
)
SELECT page_id, j.host, j.path, rule,
  coalesce(r.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, coalesce(listed, false) AS listed
FROM judged j LEFT JOIN rules r ON j.rule = r.host || r.path
"""
