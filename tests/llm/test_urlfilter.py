import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import urlfilter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0])) if fits else None


def canonical(url):
    host, path = parts(url)
    if not host:
        return None
    m = re.match(r"[^#?]*\?([^#]*)", url)
    query = "&".join(q for q in m[1].split("&") if not q.startswith("utm_")) if m else ""
    return re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + query if query else "")


URLS = [
    None, "", "no scheme.org/x", "http://", "http://Example.ORG/es/1", "https://a.b.example.org/en/12?x", "http://example.org", "http://example.org?/es/", "http://example.org#/es/", "http://example.org/es", "ftp://org/",
    "http://x.com/fr/a://y", "http://xcom/fr/", "http://notexample.org/es/1", "http://É.com/de/", "HTTP://WWW.Spam-x.net/p/?utm_a=1&b=2&utm_c=3#f", "http://spam-x.net/p?b=2", "http://spam-x.net/p?b=3", "http://host:80/de/", "a\nb://c.net/x", "http://c.net/x\ny",
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    urls = URLS + ["http://%s.%s/%s/%d%s" % (rng.choice(["a", "www.b", "example"]), rng.choice(["org", "com", "net"]), rng.choice(["es", "en", "de", "fr"]), rng.randrange(300), rng.choice(["", "/", "?utm_s=1", "?p=2#t"])) for _ in range(400)]
    return urls, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


@pytest.mark.parametrize("blocks", [None, 1, 64])
def test_against_brute_force(spark, pages, blocks):
    """Also with a filter of one block, where nearly every page is a possible hit."""
    urls, df = pages
    listed = [u for u in urls[len(URLS) :][::7] if u] + ["http://www.spam-x.net/p?b=2", None]
    found = urlfilter.filter_urls(df, spark.createDataFrame([(u,) for u in listed], "url string"), blocks=blocks)
    keys = {canonical(u) for u in listed} - {None}
    got = {r["page_id"]: r for r in found.collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = parts(u)
        r = rule(host, path)
        hit = canonical(u) in keys
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["listed"], got[i]["verdict"]) == (host, path, r and r[0], hit, r[1] if r else "block" if hit else "allow"), u


def test_filter_passes_few_others_and_all_listed(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h.net/"), F.col("id")).alias("u"))
    blocks = 128
    bloom = urlfilter.bloom_filter(listed, "u", blocks)
    tried = spark.range(4000).select("id", F.concat(F.lit("h.net/"), F.col("id")).alias("u")).withColumn("block", urlfilter._block(F.col("u"), blocks)).join(bloom, "block", "left")
    passed = F.lit(True)
    for i, bit in enumerate(urlfilter._bits(F.col("u"))):
        passed = passed & F.coalesce(F.col(f"w{i}").bitwiseAND(bit) != 0, F.lit(False))
    ids = {r["id"] for r in tried.where(passed).collect()}
    assert ids >= set(range(2000)) and len(ids) < 2000 + 200


def test_edge_cases(spark, pages, table_dir):
    _, df = pages
    none = spark.createDataFrame([], "url string")
    assert not urlfilter.filter_urls(df, none).where("listed").count()
    assert urlfilter.filter_urls(df.limit(0), df).count() == 0
    clash = df.withColumns({n: F.lit("clash") for n in ("id", "host", "path", "rule", "verdict", "block", "key", "listed", "w0", "ruled", "possible", "listed_url")})
    key = lambda d: sorted(map(str, d.collect()))
    assert key(urlfilter.filter_urls(clash, df)) == key(urlfilter.filter_urls(df, df))
    assert urlfilter.filter_urls(df.union(df), df).count() == 2 * df.count()
    plan = urlfilter.filter_urls(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    from quern.llm.queries import QUERIES

    got = {r["page_id"]: r["verdict"] for r in QUERIES["op10_url_filter"](spark, table_dir).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_sql_oracle(spark, pages, tmp_path):
    _, df = pages
    df.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, c.execute(urlfilter.OP10_SQL).fetchall()))
    got = urlfilter.op10_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "listed")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
