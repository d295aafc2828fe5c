import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.url_filter import WORDS, Rule, blocked_bloom, filter_urls, with_may

from . import brute

RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/")]


def host_and_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def canonical(url):
    host, path = host_and_path(url)
    host = host.removeprefix("www.")
    return (host, path.rstrip("/")) if host else None


def expected(url, listed):
    host, path = host_and_path(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    return host, path, None, "block" if canonical(url) in listed else "allow"


def urls(rng, n):
    hosts = ["a.net", "www.a.net", "X.example.org", "example.org", "notexample.org", "b.com", "deep.b.com", "c.net", "borg"]
    return [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'fr'])}/{rng.randrange(40)}{rng.choice(['', '/', '#top', '?utm_source=x'])}" for _ in range(n)]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
@pytest.mark.parametrize("bits", [16, 1])
def test_equals_brute_force(spark, broadcast_rows, bits):
    rng = random.Random(bits)
    found = [None, "", "no scheme/en/1", "://", "http://", "http://org", "http://ORG/", "http://a.net?x", "http://a.net#y", *urls(rng, 400), *["http://hot.net/p"] * 300, *["http://cold.net/p"] * 300]
    listing = [None, "", "nothing", "https://hot.net/p/", "https://hot.net/p/", *urls(rng, 60)]
    pages = spark.createDataFrame([(k // 2, u) for k, u in enumerate(found)], "page_id long, url string")
    got = brute.rows(filter_urls(pages, spark.createDataFrame([(u,) for u in listing], "url string"), RULES, bits_per_url=bits, broadcast_rows=broadcast_rows))
    listed = {canonical(u) for u in listing} - {None}
    want = [(k // 2, *expected(u, listed)) for k, u in enumerate(found)]
    assert sorted(map(repr, (tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got))) == sorted(map(repr, want))


def test_empty_tables_null_ids_and_clashing_names(spark):
    schema = "page_id long, url string, canonical int, host int, id int, n int, may int, hit int, block int, w0 int"
    pages = spark.createDataFrame([(None, "http://x.net/1", *[0] * 8), (None, None, *[1] * 8)], schema)
    none = spark.createDataFrame([], "url string, canonical int")
    assert {(r["host"], r["verdict"]) for r in brute.rows(filter_urls(pages, none))} == {("x.net", "allow"), ("", "allow")}
    assert {r["verdict"] for r in brute.rows(filter_urls(pages, pages))} == {"block", "allow"}
    assert filter_urls(pages.limit(0), pages).count() == 0


def test_long_url(spark):
    long = "http://x.net/" + "a/" * 200_000
    pages = spark.createDataFrame([(1, long), (2, long[:-3])], "page_id long, url string")
    assert {(r["page_id"], r["verdict"]) for r in brute.rows(filter_urls(pages, pages.where("page_id = 1")))} == {(1, "block"), (2, "allow")}


def test_filter_lets_few_others_through(spark):
    listed = spark.range(5000).select(F.concat(F.lit("https://x/"), "id").alias("canonical"))
    bloom, blocks = blocked_bloom(listed, 5000)
    assert blocks == -(-5000 * 16 // 512) and bloom.count() <= blocks and len(bloom.columns) == WORDS + 1
    assert with_may(listed, bloom, blocks, True).where("may").count() == 5000
    others = spark.range(50_000).select(F.concat(F.lit("https://y/"), "id").alias("canonical"))
    assert with_may(others, bloom, blocks, False).where("may").count() < 250
