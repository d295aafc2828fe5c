import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import catalog, fixtures
from tidemark.operators import bars as B
from tidemark.operators import breaks as K


def bars_table(spark, rows):
    return spark.createDataFrame(rows, "market_id string, outcome string, t long, break_score double, abs_price_return_pct double, volume_ratio_signal double, is_break boolean").withColumn("bar_start", F.timestamp_seconds("t")).drop("t")


def test_radius_suppression_equals_greedy(spark):
    rng = random.Random(4)
    rows = [(m, "x", k * 600, float(rng.randrange(5)), float(rng.randrange(3)), float(rng.randrange(2)), True) for m in "abc" for k in rng.sample(range(3000), 150)]
    got = {(r[0], r[1]) for r in K.radius_nms(bars_table(spark, rows), 3600).select("market_id", F.unix_timestamp("bar_start")).collect()}
    want = set()
    for m in "abc":
        kept = []
        for r in sorted((r for r in rows if r[0] == m), key=lambda r: (-r[3], -r[4], -r[5], r[2])):
            if all(abs(r[2] - t) > 3600 for t in kept):
                kept.append(r[2])
        want |= {(m, t) for t in kept}
    assert got == want and len(want) < len(rows)
    assert K.radius_nms(bars_table(spark, rows), None).count() == len(rows)


def test_exactly_at_the_radius_is_suppressed(spark):
    rows = [("a", "x", 0, 2.0, 1.0, 1.0, True), ("a", "x", 3600, 1.0, 1.0, 1.0, True), ("a", "x", 7201, 1.0, 1.0, 1.0, True)]
    assert {r[0] for r in K.radius_nms(bars_table(spark, rows), 3600).select(F.unix_timestamp("bar_start")).collect()} == {0, 7201}


def test_merge_counts_bars_and_keeps_the_first_best(spark):
    flags = [True, True, False, True, False, False, True]
    rows = [("a", "x", k * 60, s, 1.0, 1.0, f) for k, (f, s) in enumerate(zip(flags, [1.0, 3.0, 0.0, 3.0, 0.0, 0.0, 1.0], strict=True))]
    at = lambda gap: sorted(r[0] // 60 for r in K.merge_neighbors(bars_table(spark, rows), gap).select(F.unix_timestamp("bar_start")).collect())
    assert at(1) == [1, 3, 6] and at(2) == [1, 6] and at(3) == [1]


def test_bars_windows_and_ewma_equal_pandas(spark, sf):
    trades = fixtures.trades(spark, sf)
    bars = K.break_bars(trades, K.BreakConfig(interval="1h", auto_select_outcome=False))
    out = B.ewma(bars, "price_plot", 12, "smooth").toPandas().sort_values(["market_id", "outcome", "bar_start"])
    raw = trades.toPandas()
    for key, mine in out.groupby(["market_id", "outcome"]):
        t = raw[(raw.market_id == key[0]) & (raw.outcome == key[1])].set_index("timestamp_utc").sort_index()
        volume = t["size"].resample("1h").sum()
        price = t["price"].resample("1h").last().ffill()
        assert mine["n_trades"].tolist() == t["price"].resample("1h").size().tolist()
        for got, want in (
            (mine["volume"], volume), (mine["price_plot"], price), (mine["volume_baseline"], volume.shift(1).rolling(96, min_periods=24).median()),
            (mine["volume_q75"], volume.shift(1).rolling(96, min_periods=24).quantile(0.75)), (mine["smooth"], price.ewm(span=12, adjust=False, min_periods=1).mean()),
        ):
            pd.testing.assert_series_equal(got.reset_index(drop=True), want.reset_index(drop=True), check_names=False, rtol=1e-9)


def test_kept_breaks_are_apart_and_every_candidate_has_a_stronger_neighbour(spark, sf):
    c = K.BreakConfig(interval="1h", break_radius="6h")
    found = K.detect_breaks(fixtures.trades(spark, sf), c)
    every = K.merge_neighbors(found.bars, 1).select("market_id", "bar_start", "break_score").collect()
    kept = {(r.market_id, r.bar_start) for r in found.candidates.select("market_id", "bar_start").collect()}
    assert kept
    for r in every:
        near = [k for k in kept if k[0] == r.market_id and abs((k[1] - r.bar_start).total_seconds()) <= 6 * 3600]
        assert near == [(r.market_id, r.bar_start)] if (r.market_id, r.bar_start) in kept else near


def test_odd_intervals_start_at_midnight(spark):
    t = spark.createDataFrame([("m", "o", "2024-01-02 08:00:00", 1.0, 2.0, 1), ("m", "o", "2024-01-02 23:30:00", 2.0, 3.0, 2)], "market_id string, outcome string, t string, price double, size double, seq long").withColumn("timestamp_utc", F.col("t").cast("timestamp"))
    got = [(r[0], r[1]) for r in B.ohlc_bars(t, 7 * 3600).orderBy("bar_start").select(F.date_format("bar_start", "HH"), "n_trades").collect()]
    assert got == [("07", 1), ("14", 0), ("21", 1)]


def test_outcomes(spark):
    t = spark.createDataFrame([("m", "Yes"), ("m", None)], "market_id string, outcome string")
    with pytest.raises(ValueError, match="Yes"):
        B.filter_outcome(t, "maybe")
    assert B.filter_outcome(t, "YES ").count() == 1


def test_report_and_streams(spark, sf):
    assert catalog.QUERIES["break_report"](spark, sf).count() > 0
    closed = {(r["market_id"], r["outcome"], r["at"]): r["n_trades"] for r in catalog.QUERIES["stream_bars"](spark, sf).collect()}
    batch = {(r["market_id"], r["outcome"], r["at"]): r["n_trades"] for r in catalog._keyed(B.ohlc_bars(fixtures.trades(spark, sf), B.DAY), "n_trades").collect()}
    assert closed and all(batch[k] == n for k, n in closed.items())


def test_streamed_bars_equal_all_batch_bars(spark, sf):
    bars = lambda df: sorted(map(tuple, df.select("market_id", "outcome", "at", "n_trades", "volume").collect()))
    batch = B.ohlc_bars(fixtures.trades(spark, sf), B.DAY).where("n_trades > 0")
    assert bars(catalog.QUERIES["stream_bars"](spark, sf)) == bars(catalog._keyed(batch, "n_trades", catalog._r("volume").alias("volume")))


def test_ewma_with_gaps_equals_pandas(spark):
    rng = random.Random(6)
    rows = []
    for key, n, share in (("a", 4, 0.5), ("b", 3000, 0.3), ("c", 3000, 0.98), ("d", 200, 0.0), ("e", 1, 1.0)):
        rows += [(key, "x", t, rng.random() * 10 if rng.random() < share else None) for t in range(n)]
    rows += [("f", "x", 0, 7.0), *[("f", "x", t, None) for t in range(1, 60)], ("g", "x", 0, 1.0), ("g", "x", 1, None), ("g", "x", 2, None), ("g", "x", 3, 5.0)]
    rows += [("h", "x", t, {0: 1.0, 2500: 4.0, 2501: 6.0}.get(t)) for t in range(2503)]
    df = spark.createDataFrame(rows, "market_id string, outcome string, t long, v double").withColumn("bar_start", F.timestamp_seconds("t"))
    for span in (1, 2, 4, 12, 500):
        got = B.ewma(df, "v", span, "m").toPandas().sort_values(["market_id", "t"])
        for key, mine in got.groupby("market_id"):
            v = pd.Series([r[3] for r in rows if r[0] == key], dtype="float64")
            pd.testing.assert_series_equal(mine["m"].reset_index(drop=True), v.ewm(span=span, adjust=False, min_periods=1).mean(), check_names=False, rtol=1e-9)


def greedy(rows, radius):
    """rows: (market, second, score, return, volume); what the greedy choice from the strongest on keeps."""
    import bisect

    kept = {}
    for m, t, *x in sorted(rows, key=lambda r: (-r[2], -r[3], -r[4], r[1])):
        mine = kept.setdefault(m, [])
        k = bisect.bisect_left(mine, t)
        if all(abs(t - o) > radius for o in mine[max(0, k - 1) : k + 1]):
            mine.insert(k, t)
    return {(m, t) for m, mine in kept.items() for t in mine}


@pytest.mark.parametrize("fold", [0, 3, 40])
def test_rounds_equal_the_greedy_choice(spark, fold):
    rng = random.Random(fold)
    rows = [(m, t, float(rng.randrange(6)), float(rng.randrange(3)), 1.0) for m in ("a", "b", None) for t in rng.sample(range(20_000), 120)]
    df = bars_table(spark, [(m, "x", t, *x, True) for m, t, *x in rows])
    assert {tuple(r) for r in K.radius_nms(df, 600, fold=fold).select("market_id", F.unix_timestamp("bar_start")).collect()} == greedy(rows, 600)


def test_an_island_of_100_000_breaks(spark):
    rng = random.Random(1)
    rows = [("a", k * 60, rng.random(), 1.0, 1.0) for k in range(100_000)]
    pdf = pd.DataFrame(rows, columns=["market_id", "t", "break_score", "abs_price_return_pct", "volume_ratio_signal"])
    df = spark.createDataFrame(pdf).withColumns({"outcome": F.lit("x"), "bar_start": F.timestamp_seconds("t")})
    got = {tuple(r) for r in K.radius_nms(df, 1800).select("market_id", "t").collect()}
    assert got == greedy(rows, 1800) and len(got) > 1000


@pytest.mark.parametrize("fold", [0, 99])
def test_missing_scores_are_the_weakest(spark, fold):
    rows = [("a", "x", 0, None, 9.0, 9.0, True), ("a", "x", 60, 1.0, None, None, True), ("a", "x", 120, 1.0, 0.0, None, True)]
    assert {r[0] for r in K.radius_nms(bars_table(spark, rows), 60, fold=fold).select(F.unix_timestamp("bar_start")).collect()} == {0, 120}


def test_a_hot_bucket_is_split(spark):
    articles = spark.range(20_000).select(F.timestamp_seconds(F.col("id") % 100).alias("at"), F.col("id").alias("n"), F.lit(5).alias("seq"))
    breaks = spark.range(60).select(F.timestamp_seconds(F.col("id")).alias("bar_start"))
    near = K.near_breaks(articles, "at", breaks, 30, pairs=50_000)
    want = sum(200 for a in range(100) for b in range(60) if abs(a - b) <= 30)
    assert near.count() == want and near.columns == ["at", "n", "seq", "break_timestamp"]
    sizes = near.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1
    far = K.near_breaks(articles, "at", breaks.where("false"), 30)
    assert far.count() == 0
