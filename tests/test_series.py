"""Series that are split over many partitions, against the same columns by windows and pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B


@pytest.fixture(scope="module")
def series(spark):
    """One market of nearly all rows, a small one, one without an outcome and one without any value; many gaps."""
    rng = random.Random(7)
    rows = [("big", "Yes", k * 60, rng.uniform(1, 9) if rng.random() < 0.4 and not 500 < k < 1500 else None) for k in range(4000)]
    rows += [("small", "No", k * 60, float(k) if k % 3 else None) for k in range(40)] + [("bare", None, k * 60, float(k)) for k in range(10)] + [("none", "Yes", k * 60, None) for k in range(50)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "market_id string, outcome string, t long, x double").withColumns({"bar_start": F.timestamp_seconds("t"), "timestamp_utc": F.timestamp_seconds("t"), "seq": F.col("t")}).cache()


def column(df, name):
    return {(r["market_id"], r["outcome"], r["t"]): r[name] for r in df.collect()}


@pytest.mark.parametrize("segments", [1, 13])
@pytest.mark.parametrize("span", [1, 2, 24, 100_000])
def test_ewma_over_segments(series, segments, span):
    got = column(B.ewma(series, "x", span, "mean", segments=segments), "mean")
    want = {}
    for key, mine in series.toPandas().groupby(["market_id", "outcome"], dropna=False):
        mine = mine.sort_values("t")
        for t, value in zip(mine["t"], mine["x"].ewm(span=span, adjust=False, min_periods=1).mean(), strict=True):
            want[(key[0], None if pd.isna(key[1]) else key[1], t)] = None if pd.isna(value) else value
    assert got.keys() == want.keys()
    assert all(got[k] is None if w is None else got[k] == pytest.approx(w, rel=1e-9) for k, w in want.items())


@pytest.mark.parametrize("segments", [1, 13])
def test_forward_fill_and_gaps_over_segments(series, segments):
    assert column(B.fill_forward(series, "x", "held", segments=segments), "held") == column(B.fill_forward(series, "x", "held"), "held")
    assert column(B.inter_trade_seconds(series, B.KEYS, segments), "inter_trade_seconds") == column(B.inter_trade_seconds(series, B.KEYS), "inter_trade_seconds")


def test_no_task_holds_the_big_key(series):
    from tidemark.operators.series import _ranged

    parts = _ranged(series, B.KEYS, ["bar_start"], 13).where("market_id = 'big'").groupBy("__part").count().collect()
    assert len(parts) > 9 and max(r["count"] for r in parts) < 1200


def test_long_gaps_between_bars(spark, monkeypatch):
    trades = spark.createDataFrame([("m", "Yes", 0), ("m", "Yes", 4_000_000), ("m", "Yes", 4_000_007)], "market_id string, outcome string, t long").withColumns({"bar_start": F.timestamp_seconds("t"), "n": F.lit(1)})
    assert B.fill_bars(trades, 1, B.KEYS, ["n"]).agg(F.count("*"), F.sum("n"), F.countDistinct("bar_start")).first() == (4_000_008, 3, 4_000_008)
    monkeypatch.setattr(B, "CHUNK", 3)
    filled = B.fill_bars(trades.where("t > 0"), 1, B.KEYS, ["n"]).orderBy("bar_start").select(F.unix_seconds("bar_start"), "n")
    assert [tuple(r) for r in filled.collect()] == [(4_000_000 + k, int(k in (0, 7))) for k in range(8)]
    with pytest.raises(Exception, match="too many empty bars"):
        B.fill_bars(trades, 1, B.KEYS, ["n"], most_bars=1000).count()
