import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as Te
from tidemark.functions import values as V


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_clean_text_and_keys(spark):
    assert one(spark, [" a ", "", None, "nan", "<NA>", "None", "\t\n", "none"], Te.clean_text) == ["a", None, None, None, None, None, None, "none"]
    assert one(spark, ["  A \n b  "], Te.text_key) == ["a b"]


def test_urls(spark):
    urls = ["HTTP://www.A.example:80/x/?b=2&a=1&utm_z=3#f", "https://u@b.example", "no url", None, "//c.example/p;v=1?q=%zz&r=a+b", "https://d.example/?k=&=v&x=~*", "https://e.example/a;b/c;d"]
    assert one(spark, urls, Te.url_domain) == ["a.example:80", "u@b.example", None, None, "c.example", "d.example", "e.example"]
    assert one(spark, urls, Te.canonical_url) == [
        "https://a.example:80/x?a=1&b=2", "https://u@b.example/", None, None, "https://c.example/p?q=%25zz&r=a+b", "https://d.example/?x=~%2A", "https://e.example/a;b/c",
    ]


def test_market_urls_and_slugs(spark):
    got = one(spark, ["https://h.example/event/a%20b+c/x?q", "https://h.example/market/s-12", "https://h.example/event/", "/event/x", "https://h.example/user/x"], Te.market_url)
    assert [tuple(x) if x else None for x in got] == [("event", "a b+c"), ("market", "s-12"), None, None, None]
    assert one(spark, ["s-12", "s", "-12", "a-1-2"], Te.slug_variants) == [["s-12", "s"], ["s"], ["-12"], ["a-1-2", "a-1"]]


def test_numbers_and_flags(spark):
    assert one(spark, ["1.5", " 2 ", "nan", "x", None, "1e3", "-0"], V.number) == [1.5, 2.0, None, None, None, 1000.0, 0.0]
    assert one(spark, ["7", " -7 ", "0x7", "1.0", None], V.whole) == [7, -7, None, None, None]
    assert one(spark, ["True", "YES", "y", "1", "0", "no", "", None, "2", "nan"], V.flag) == [True, True, True, True, False, False, False, False, True, False]


def test_times(spark):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    day = "2024-01-01 00:00:00"
    assert one(spark, ["1704067200", "1704067200000", "1704067200000000", "1704067200000000000", "2024-01-01", "2024-01-01T02:00:00+02:00", "2024-1", "x", None], lambda c: text(V.epoch_ts(c))) == [day] * 6 + [None] * 3
    assert one(spark, ["20240101000000", "1704067200", "1704067200000", "2024-01-01T00:00:00Z", "20241301000000", ""], lambda c: text(V.article_ts(c))) == [day] * 4 + [None] * 2
    assert one(spark, ["15m", "2H", "1w", "0s", "m", "3 d", None], V.span_seconds) == [900, 7200, 604800, None, None, None, None]
    assert V.parse_span("15min") == 900 and V.parse_span("3h") == 10800 and V.parse_span(None) is None and V.parse_span("0h") is None
    with pytest.raises(ValueError):
        V.time_bounds("2024-02-01", "2024-01-01", None, "2024-03-01")


def test_lists(spark):
    assert one(spark, ['["a","b"]', "a, 'b',,", "a", "", None, "[bad", "[1, 2]"], V.as_list) == [["a", "b"], ["a", "b"], ["a"], [], None, ["[bad"], ["1", "2"]]


def test_language_and_names(spark):
    assert one(spark, ["EN", " english", "eng", "de", None], lambda c: Te.language_matches(c, "English")) == [True, True, True, False, False]
    assert one(spark, ["eng", "english", "en"], lambda c: Te.language_matches(c, "en")) == [False, True, True]
    assert [Te.snake_case(x) for x in ("conditionId", "clobTokenIds", "volume24hrClob", "HTTPServer", "a-b", "already_snake")] == ["condition_id", "clob_token_ids", "volume24hr_clob", "http_server", "a_b", "already_snake"]
