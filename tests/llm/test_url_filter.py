"""URL filter against a direct reading of the contract and against DuckDB."""

import re

import duckdb

from geoverity.llm import url_filter as U

URLS = [None, "", "nothing", "http://", "http://example.org", "HTTP://Sub.Example.ORG/es/x?y#z", "http://example.org/en/12",
        "http://example.org/en/2", "https://notexample.org/es/", "http://a.com/fr/", "http://com/de/a", "http://x.com:80/de/a",
        "a://b://example.org/es/", "http://example.org?x=/es/", "http://spam-farm.example.net/x", "http://foo.net/cgi-bin/a",
        "http://é.org/ES/", "http://foo.net/a.exe?x", "http://foo.net/a.EXE", "http://foo.net/x?action=edit", "http://ads1.foo.net/\n/x",
        "http://foo.net/robots.txt", "http://spam-farm.net/robots.txt", "http://spam-farm.org/", "http://foo.net/search?q=1"]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    host = lower(host)
    fit = [(len(h + p), h + p, v) for h, p, v in U.HOST_RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = lower(url or "")
    by = {v for x, _, v in U.PATTERN_RULES if url is not None and re.search(x, low)}
    verdict = max(fit)[2] if fit else "block" if "block" in by and "allow" not in by else "allow"
    return host, path, max(fit)[1] if fit else None, verdict


def test_brute_force(spark):
    rows = [(i if i % 5 else None, u, "h", 1) for i, u in enumerate(URLS + URLS[:6])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, token int")
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect())))
    assert got == sorted(str((i, *expected(u))) for i, u, *_ in rows)
    assert U.filter_urls(df.limit(0)).count() == 0


def test_literal_tokens_are_needed():
    """A pattern's tokens stand as whole tokens in every url it fits (spot check by removal)."""
    for rule, tokens, _ in U.PATTERN_RULES:
        assert all(re.search(rf"(?<![0-9a-z]){t}(?![0-9a-z])", re.sub(r"\\", "", rule)) for t in tokens), rule


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(str, U.op4_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    rel = con.sql(U.ORACLE)
    from pyspark.sql import Row
    make = Row(*rel.columns)
    assert got == sorted(str(make(*r)) for r in rel.fetchall())


def test_rules_filed_under_each_token(spark):
    """The verdict doesn't hang on which token of a rule is the rarest: every rule is filed under each in turn."""
    urls = [*(u for u in URLS if u), "http://foo.net/wp-login.php5", "http://foo.net/wp-login.php", "http://foo.net/tag/a/feed/"]
    rows = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(str((i, *expected(u))) for i, u in rows)
    for k in range(max(len(t) for _, t, _ in U.PATTERN_RULES)):
        rules = [(x, t[min(k, len(t) - 1):][:1], v) for x, t, v in U.PATTERN_RULES]
        got = U.filter_urls(df, pattern_rules=rules).collect()
        assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == want, k
    whole = U.filter_urls(df.where("url LIKE '%wp-login.php5'").union(spark.createDataFrame(
        [(100 + i, "http://foo.net/wp/login") for i in range(3)], "page_id long, url string"))).where("page_id < 100").first()
    assert whole.verdict == "block"
