import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fills as L
from tidemark.operators import markets as M
from tidemark.operators import news as N
from tidemark.operators import tables as Ta
from tidemark.plans import pipelines as P
from tidemark.sources import records as R


def test_percentile_rank_equals_pandas(spark):
    values = [None, 3.0, 1.0, 3.0, 2.0, None, 9.0, 1.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    want = df.toPandas()["v"].rank(pct=True, method="average").fillna(0.0).tolist()
    assert [r[0] for r in Ta.percentile_rank(df, "v", "p").orderBy("k").select("p").collect()] == pytest.approx(want)


def test_first_by_key_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 0), (4, None, 0), (5, "b", 0)], "id int, key string, rank int")
    assert sorted(r[0] for r in Ta.first_by_key(df, F.col("key"), F.col("rank")).collect()) == [2, 3, 4, 5]


def test_market_keys_and_schema(spark):
    df = spark.createDataFrame([(" ", "7", "s", 0), ("", "7", "t", 1), (None, None, "7", 2), (None, " ", "", 3), (None, None, None, 4)], "condition_id string, id string, slug string, n int")
    assert sorted(r["n"] for r in M.dedupe_markets(df, F.col("n")).collect()) == [0, 3, 4]
    with pytest.raises(ValueError, match="liquidity"):
        M.rank_schema_check(df)
    empty = M.rank_markets(spark.createDataFrame([], "condition_id string, question string"), 5)
    assert empty.count() == 0 and "market_score" in empty.columns


def test_first_existing_column_not_first_value(spark):
    df = spark.createDataFrame([(None, 5.0)], "liquidity_clob double, liquidity double")
    assert df.select(Ta.first_present(df, M.ALIASES["liquidity"])).first()[0] is None


def test_fills_with_unknown_and_zero_sides(spark):
    rows = [("1", "1704067200", "h", "A", "0", "0", "5"), ("2", "1704067200", "h", "0", "B", "4", "8"), ("3", "1704067200", "h", "A", "B", "2", "1"), ("4", "x", "h", "A", "0", "1", "1"), ("5", "1704067200", "h", "X", "Y", "10", "4")]
    fills = spark.createDataFrame(rows, R.FILL_SCHEMA)
    tokens = spark.createDataFrame([("m", "A", "Yes"), ("m", "B", "No")], "condition_id string, asset_id string, outcome string")
    got = sorted((r["seq"], r["asset_id"], r["price"], r["size"], r["outcome"]) for r in L.normalize_fills_for_asset(fills, tokens).collect())
    assert got == [("1", "A", None, 0.0, "Yes"), ("2", "B", 0.5, 8.0, "No"), ("3", "A", 0.5, 2.0, "Yes"), ("3", "B", 2.0, 1.0, "No")]
    loose = {r["seq"]: (r["price"], r["size"], r["outcome"]) for r in L.normalize_fills(fills, tokens).collect()}
    assert loose["3"] == (0.5, 2.0, "Yes") and loose["5"] == (0.4, 10.0, None) and "4" not in loose


def test_trades_of_zeros_keep_the_last_alias(spark):
    rows = [("1", 0.0, 0.0, "0", None), ("2", 0.5, 0.0, "3", "0"), ("3", None, 0.7, "", "5"), ("4", 0.0, None, None, "0")]
    raw = spark.createDataFrame(rows, "hash string, price double, rate double, amount string, shares string").withColumn("time", F.lit(1704067200))
    got = {r["transaction_hash"]: (r["price"], r["size"]) for r in L.normalize_trades(raw).collect()}
    assert got == {"1": (0.0, None), "2": (0.5, 3.0), "3": (0.7, 5.0), "4": (None, 0.0)}


def test_size_scales(spark):
    rows = [("raw", 2e8, 0.5)] * 9 + [("raw", 1e8, 0.6), ("plain", 2.5, 0.5), ("big", 1e18, 0.5), ("odd", 3e8, 7.0), ("none", -1.0, 0.1)]
    got = {r["market_id"]: r["scale"] for r in L.size_scale(spark.createDataFrame(rows, "market_id string, size double, price double")).collect()}
    assert got == {"raw": 1e6, "plain": 1.0, "big": 1e18, "odd": 1.0, "none": 1.0}


def _plan(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture
def no_small_joins(spark):
    """Joins go by a shuffle unless a broadcast is asked for, as for large tables."""
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def test_one_markets_trades_stay_where_they_are(spark, no_small_joins):
    trades = spark.range(4000).select(F.lit("m").alias("market_id"), (F.col("id") % 9 + 1.0).alias("size"), F.lit(0.5).alias("price")).repartition(4)
    sized = L.normalize_size(trades)
    assert sized.groupBy(F.spark_partition_id()).count().count() > 1 and sized.agg(F.sum("size")).first()[0] == sum(k % 9 + 1.0 for k in range(4000))
    assert "SortMergeJoin [key" not in _plan(spark, Ta.exact_quantiles(trades, ["market_id"], {"q": (F.col("size"), 0.5)}))


def test_one_assets_fills_stay_where_they_are(spark, no_small_joins, monkeypatch):
    fills = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), F.lit("1704067200").alias("timestamp"), F.lit("h").alias("transactionHash"),
        F.lit("7").alias("makerAssetId"), F.lit("0").alias("takerAssetId"), F.lit("4").alias("makerAmountFilled"), F.lit("2").alias("takerAmountFilled"),
    ).repartition(4)
    tokens = spark.createDataFrame([("m", "7", "Yes"), ("m", "7", "Yes"), ("n", "8", "No")], "condition_id string, asset_id string, outcome string")
    trades = L.normalize_fills_for_asset(fills, tokens)
    assert "SortMergeJoin" not in _plan(spark, trades) and trades.groupBy(F.spark_partition_id()).count().count() > 1
    monkeypatch.setattr(Ta, "BROADCAST_ROWS", 0)
    many = L.normalize_fills_for_asset(fills, tokens)
    assert "SortMergeJoin" in _plan(spark, many) and many.count() == 4000 and many.exceptAll(trades).count() == 0


def test_trades_are_dealt_by_their_count(spark, no_small_joins, monkeypatch):
    monkeypatch.setattr(Ta, "TASK_ROWS", 20)
    twice = F.floor(F.col("id") / 2)
    fills = spark.range(300).select(
        twice.cast("string").alias("id"), (twice + 1704067200).cast("string").alias("timestamp"), twice.cast("string").alias("transactionHash"),
        F.lit("7").alias("makerAssetId"), F.lit("0").alias("takerAssetId"), F.lit("4").alias("makerAmountFilled"), F.lit("2").alias("takerAmountFilled"),
    )
    markets = spark.createDataFrame([("m", '["7"]', '["Yes"]')], "condition_id string, clob_token_ids string, outcomes string")
    trades = P.trades_from_fills(fills, markets)
    assert [int(r["transaction_hash"]) for r in trades.collect()] == list(range(150))
    assert ", 15), REPARTITION_BY_NUM" in _plan(spark, trades) and "SortMergeJoin" not in _plan(spark, trades)


def test_tokens_with_unequal_counts_and_objects(spark):
    rows = [("a", "1, 2", '["x"]'), ("b", '["3","3"," 4"]', '[{"name":"n"},{"title":"t"}]'), ("c", None, None)]
    got = sorted((r["condition_id"], r["asset_id"], r["outcome"]) for r in L.market_tokens(spark.createDataFrame(rows, "condition_id string, clob_token_ids string, outcomes string")).collect())
    assert got == [("a", "1", None), ("a", "2", None), ("b", "3", "n"), ("b", "4", "t")]


def test_envelopes(spark):
    rows = [(1, '[{"a":1},2]'), (2, '{"items":[{"a":2}],"data":{}}'), (3, '{"x":1}'), (4, "bad"), (5, None)]
    df = spark.createDataFrame(rows, "k int, payload string")
    assert sorted((r["k"], r["item"]) for r in R.flatten_envelope(df, "payload").collect()) == [(1, '{"a":1}'), (2, '{"a":2}')]
    assert sorted((r["k"], r["item"]) for r in R.flatten_envelope(df, "payload", wrap=True).collect())[1] == (1, '{"value":"2"}')


def test_pick_market_says_why(spark):
    rows = [("one", 0, "a", "0x1"), ("two", 0, "a", "0x2"), ("two", 1, "b", None), ("bare", 0, "c", None)]
    events = spark.createDataFrame(rows, "event string, pos int, slug string, condition_id string")
    by = lambda **k: {r["event"]: (r["status"], r["condition_id"]) for r in M.pick_market(events, **k).collect()}
    assert by() == {"one": ("ok", "0x1"), "two": ("choose one by slug or index", None), "bare": ("no condition id", None)}
    assert by(slug="b")["two"] == ("no condition id", None) and by(index=0)["two"] == ("ok", "0x2") and by(index=3)["one"] == ("not found", None)


def test_articles_keep_rows_without_a_key_and_choose_by_time(spark):
    rows = [("20240101000000", "T", "http://a.example/x?utm_a=1"), ("20240102000000", "U", "https://www.a.example/x/"), ("20240103000000", None, None), ("20240104000000", "", " "), ("bad", "V", None)]
    raw = spark.createDataFrame(rows, "seendate string, title string, url string")
    news = N.normalize_articles(raw)
    assert news.count() == 4
    assert sorted(r["title"] or "" for r in N.dedupe_articles(news).collect()) == ["", "", "T"]
    assert sorted(r["title"] or "" for r in N.dedupe_articles(news, "newest").collect()) == ["", "", "U"]


def test_nested_names(spark):
    df = spark.createDataFrame([((1, [(2,)]),)], "eventData struct<marketId:int,subItems:array<struct<tokenId:int>>>")
    assert Ta.snake_case_columns(df).schema.simpleString() == "struct<event_data:struct<market_id:int,sub_items:array<struct<token_id:int>>>>"


def test_quantiles_by_selection_equal_numpy(spark):
    rng = np.random.default_rng(3)
    made = {"few": [3.0, 1.0, 2.0], "one": [7.0], "none": [None], "tied": [1.0] * 500 + [2.0] * 300, "many": rng.normal(size=40_000).round(4).tolist(), "wide": (rng.pareto(0.3, 30_000)).tolist()}
    rows = [(k if k != "one" else None, v) for k, vs in made.items() for v in vs]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "v"])).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)
    fractions = {"a": 0.0, "b": 0.001, "c": 0.25, "d": 0.5, "e": 0.995, "f": 1.0}
    wanted = {n: (F.col("v"), f) for n, f in fractions.items()} | {"g": (-F.col("v"), 0.3)}
    got = {r["k"]: r for r in Ta.exact_quantiles(df, ["k"], wanted).collect()}
    assert set(got) == {"few", None, "tied", "many", "wide"}
    for k, vs in made.items():
        if k != "none":
            row = got[k if k != "one" else None]
            assert [row[n] for n in wanted] == pytest.approx([*np.quantile(vs, list(fractions.values())), np.quantile(-np.array(vs), 0.3)], rel=1e-12)
    whole = Ta.exact_quantiles(df, [], {"q": (F.col("v"), 0.37)}).first()["q"]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.37), rel=1e-12)
    assert Ta.exact_quantiles(df.where("false"), [], {"q": (F.col("v"), 0.5)}).first()["q"] is None


def test_ranks_of_ties_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": range(4000), "v": rng.choice([0.0, 0.0, 0.0, 1.0, 2.5, np.nan], 4000), "w": rng.integers(0, 50, 4000).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = Ta.percentile_ranks(df, {"v": "p", "w": "q"}).toPandas().sort_values("k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    assert got["p"].tolist() == pytest.approx(pdf["v"].rank(pct=True).fillna(0.0).tolist())
    assert got["q"].tolist() == pytest.approx(pdf["w"].rank(pct=True).tolist())


def test_ranks_are_dealt_by_their_count(spark, monkeypatch):
    monkeypatch.setattr(Ta, "TASK_ROWS", 500)
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 3).cast("double").alias("w"))
    ranked = Ta.percentile_ranks(df, {"v": "p", "w": "q"})
    assert ranked.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] < 500
    got = ranked.toPandas().sort_values("k")
    assert got["p"].tolist() == pytest.approx(got["v"].rank(pct=True).tolist()) and got["q"].tolist() == pytest.approx(got["w"].rank(pct=True).tolist())


def test_urls_of_markets_and_events(spark):
    urls = [("https://h.example/market/a-1",), ("https://h.example/market/zz-2",), ("https://h.example/event/e-7?x=1",), ("https://h.example/event/bare",), ("https://h.example/event/void",), ("https://h.example/about",), (None,), ("https://h.example/market/a-1",)]
    markets = spark.createDataFrame([("a", "0x1"), ("a-1", None), ("a", "0x0")], "slug string, condition_id string")
    events = spark.createDataFrame([("e", [("p", "0x9"), ("q", None)]), ("bare", None), ("void", []), ("e-7", None)], "slug string, markets array<struct<slug:string,condition_id:string>>")
    df = spark.createDataFrame(urls, "url string")
    got = [((r["url"] or "-")[18:], r["kind"], r["slug"], r["pos"], r["market_slug"], r["condition_id"], r["status"]) for r in M.resolve_url_markets(df, markets, events).collect()]
    assert len(got) == 8
    found = {(r[0], r[3]): r[1:] for r in got}
    assert found[("event/e-7?x=1", 0)] == ("event", "e", 0, "p", "0x9", "ok") and found[("event/e-7?x=1", 1)] == ("event", "e", 1, "q", None, "no condition id")
    assert found[("market/a-1", 0)] == ("market", "a-1", 0, "a-1", None, "no condition id")
    assert {k[0]: v[-1] for k, v in found.items() if k[1] is None} == {"market/zz-2": "not found", "event/bare": "no list of markets", "event/void": "no markets", "about": "no market or event page", "": "no market or event page"}
    assert {r["condition_id"] for r in M.resolve_url_markets(spark.createDataFrame([("https://h.example/market/a-9",)], "url string"), markets).collect()} == {"0x0"}


def test_article_caps_and_counts(spark):
    rows = [(k, [(f"t{k}{j}",) for j in range(n)] if n is not None else None) for k, n in enumerate([3, 0, None, 4, 2])]
    pages = spark.createDataFrame(rows, "page int, articles array<struct<title:string>>").repartition(3)
    titles = lambda most: [r["title"] for r in R.flatten_article_pages(pages, "page", "articles", most).orderBy("page", "pos").collect()]
    every = [f"t{k}{j}" for k, n in enumerate([3, 0, 0, 4, 2]) for j in range(n)]
    for most, read in ((1, 1), (3, 1), (4, 4), (7, 4), (8, 5), (99, 5)):
        assert titles(most) == every[:most]
        assert tuple(R.count_article_pages(pages, "page", "articles", most).first()) == (min(most, 9), read)
    assert titles(None) == every and tuple(R.count_article_pages(pages, "page", "articles").first()) == (9, 5)
    assert tuple(R.count_article_pages(pages.where("false"), "page", "articles", 5).first()) == (0, 0)


def test_json_lines_of_unlike_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"1","n":2,"x":1.5,"in":{"k":[1,2]}}\n\n{"id":"7","n":null,"x":2,"mix":1}\nbroken {\n{"id":"8","mix":"t","never":null}\n')
    df = R.scan_json_records(spark, str(tmp_path / "a.json"))
    got = {r["id"]: r.asDict(recursive=True) for r in df.collect()}
    assert got["1"] == {"id": "1", "in": {"k": [1, 2]}, "mix": None, "n": 2, "never": None, "x": 1.5}
    assert got["7"]["x"] == 2.0 and got["7"]["mix"] == "1" and got["8"]["mix"] == "t" and set(got[None].values()) == {None}
    assert dict(df.dtypes) == {"id": "string", "in": "struct<k:array<bigint>>", "mix": "string", "n": "bigint", "never": "string", "x": "double"}
    (tmp_path / "b.json").write_text('[{"a":1},{"a":2}]\n')
    assert sorted(r["a"] for r in R.scan_json_records(spark, str(tmp_path / "b.json")).collect()) == [1, 2]
