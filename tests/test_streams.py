"""Streams over files that land in turn, stopped, resumed and replayed."""

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import bars as B
from tidemark.operators import tables as Ta
from tidemark.streaming import orderbook as S
from tidemark.streaming.latest import LatestRows

SCHEMA = "received_at timestamp, seq long, message string"


def land(spark, folder, rows):
    """A file of its own for (second, seq, event, asset) rows."""
    df = spark.createDataFrame([(s, q, f'{{"event_type":"{e}","asset_id":"{a}"}}') for s, q, e, a in rows], "s long, seq long, message string")
    df.select(F.timestamp_seconds("s").alias("received_at"), "seq", "message").coalesce(1).write.mode("append").parquet(folder)


def messages(spark, folder, files=1):
    return S.message_envelope(S.stream_messages(spark, folder, files_per_trigger=files))


def test_recording_stops_at_a_count_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(6):
        land(spark, source, [(10 * k + j, 100 * k + j, "book", "a") for j in (2, 1, 0)])
    first = S.record_stream(messages(spark, source), out, state, most=4)
    assert [r["seq"] for r in first.collect()] == [0, 1, 2, 100]
    held = spark.read.parquet(out).count()
    assert 6 <= held <= 18
    assert S.record_stream(messages(spark, source), out, state, most=4).count() == 4  # it was there already
    assert [r["seq"] for r in S.record_stream(messages(spark, source), out, state, most=11).collect()] == [100 * k + j for k in range(4) for j in range(3)][:11]
    assert S.record_stream(messages(spark, source), out, state, most=99).count() == 18
    assert S.record_stream(messages(spark, source), out, state).count() == 18


def test_recording_ends_with_the_time(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    land(spark, source, [(1, 1, "book", "a")])
    assert S.record_stream(messages(spark, source), out, state, seconds=6, most=5).count() == 1


@pytest.mark.parametrize("compact", [1, 2, 50])
def test_live_snapshot_over_restarts(spark, tmp_path, compact):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    land(spark, source, [(1, 1, "book", "a"), (2, 2, "book", "b"), (3, 3, "trade", "a")])
    land(spark, source, [(5, 5, "book", "a"), (4, 4, "book", "a")])
    snapshot = lambda: {r["asset_id"]: r["seq"] for r in S.live_book_snapshot(messages(spark, source), out, state, compact=compact).collect()}
    assert snapshot() == {"a": 5, "b": 2}
    land(spark, source, [(9, 9, "book", "b"), (0, 0, "book", "a"), (9, 9, "book", "c")])
    assert snapshot() == {"a": 5, "b": 9, "c": 9}
    assert snapshot() == {"a": 5, "b": 9, "c": 9}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k string, n long, v string")
    first = rows(("a", 1, "x"))
    table = LatestRows(spark, str(tmp_path / "t"), first.schema, ["k"], ["n"], compact=3)
    assert table.read().count() == 0
    held = lambda before=None: sorted(map(tuple, table.read(before).collect()))
    for batch in range(7):
        for _ in range(2):
            table.write(rows(("a", batch, f"a{batch}"), (f"k{batch % 2}", batch, f"k{batch}")), batch)
            assert held() == sorted([("a", batch, f"a{batch}"), *[(f"k{b % 2}", b, f"k{b}") for b in range(max(0, batch - 1), batch + 1)]])
    assert held(2) == [("a", 1, "a1"), ("k0", 0, "k0"), ("k1", 1, "k1")]


def test_filled_bars_of_a_stream_equal_those_of_its_table(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "market_id string, outcome string, timestamp_utc timestamp, price double, size double, seq long"

    def landed(*rows):
        df = spark.createDataFrame(rows, "market_id string, outcome string, t long, price double, size double, seq long")
        df.select("market_id", "outcome", F.timestamp_seconds("t").alias("timestamp_utc"), "price", "size", "seq").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return S.stream_filled_bars(stream, 60, out, state, "1 seconds", compact=2)

    landed(("m", "Yes", 0, 0.5, 1.0, 1), ("m", "Yes", 30, 0.6, 1.0, 2), ("n", None, 10, 0.1, 2.0, 3))
    landed(("m", "Yes", 400, 0.7, 1.0, 4))
    run()
    landed(("n", None, 1000, 0.2, 2.0, 5), ("m", "Yes", 1000, 0.9, 1.0, 6))
    landed(("n", None, 1100, 0.3, 2.0, 7))
    run()
    S.end_of_input(spark, source, spark.read.parquet(source).schema, "timestamp_utc", 61)
    got = sorted(map(tuple, run().select("market_id", F.coalesce("outcome", F.lit("-")), F.unix_seconds("bar_start"), "n_trades", "volume", F.coalesce("price_end", F.lit(-1.0))).collect()))
    trades = spark.read.schema(schema).parquet(source).where("market_id IS NOT NULL")
    want = B.ohlc_bars(trades, 60).select("market_id", F.coalesce("outcome", F.lit("-")), F.unix_seconds("bar_start"), "n_trades", "volume", F.coalesce("price_end", F.lit(-1.0)))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 17 + 19


@pytest.mark.parametrize("task_rows, files", [(400_000, 2), (10, 3)])
def test_ranges_of_time_have_equally_many_files(spark, monkeypatch, task_rows, files):
    """Of the first range all rows have one time; its micro-batch takes no file of the next range."""
    monkeypatch.setattr(Ta, "TASK_ROWS", task_rows)
    df = spark.range(100).select("id", F.timestamp_seconds(F.when(F.col("id") < 25, 0).otherwise(F.col("id"))).alias("at"))
    path = catalog._in_turn(spark, df, "at")[1]
    held = spark.read.parquet(path)
    assert len(held.inputFiles()) == 4 * files and sorted(r["id"] for r in held.collect()) == list(range(100))


def test_a_batchs_bars_are_filled_by_adaptive_plans(spark, tmp_path, monkeypatch):
    adaptive = []
    fill = S.fill_bars
    monkeypatch.setattr(S, "fill_bars", lambda bars, *a: adaptive.append(bars.sparkSession.conf.get("spark.sql.adaptive.enabled")) or fill(bars, *a))
    rows = spark.createDataFrame([("m", "Yes", 60 * k, 0.5, 1.0, k) for k in (0, 1, 4)], "market_id string, outcome string, t long, price double, size double, seq long")
    rows = rows.withColumn("timestamp_utc", F.timestamp_seconds("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    S.stream_filled_bars(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 60, str(tmp_path / "out"), str(tmp_path / "state"), "1 seconds")
    assert adaptive and set(adaptive) == {"true"}
