"""Order-book messages, trades and bars as streams; each transform also works on a batch table."""

from __future__ import annotations

from collections.abc import Sequence
from threading import Event
from time import monotonic
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from ..operators.bars import fill_bars
from ..scratch import cut
from .latest import LatestRows

RAW = T.StructType([T.StructField("received_at", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("message", T.StringType())])


def stream_messages(spark: SparkSession, path: str, schema: T.StructType = RAW, files_per_trigger: int = 16) -> DataFrame:
    """Raw messages from files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def message_envelope(df: DataFrame) -> DataFrame:
    """received_at, seq, event_type, asset_id and the message as compact JSON; both fields are null for what is no object."""
    text = F.col("message")
    is_object = F.trim(text).startswith("{")

    def field(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(text, f"$.{n}"), F.lit("")) for n in names])

    event, asset = F.when(is_object, field("event_type", "eventType")), F.when(is_object, field("asset_id", "assetId"))
    return df.select("received_at", "seq", event.alias("event_type"), asset.alias("asset_id"), F.coalesce(F.to_json(F.try_parse_json(text)), text).alias("message"))


def subscribe_filter(messages: DataFrame, tokens: DataFrame, condition_ids: Sequence[str]) -> DataFrame:
    """Messages of the assets of those markets; ids that are no condition ids stand for assets themselves."""
    markets = [c for c in condition_ids if c.startswith("0x") and len(c) >= 10]
    assets = tokens.where(F.col("condition_id").isin(markets)).select("asset_id").union(tokens.where(F.col("asset_id").isin([c for c in condition_ids if c not in markets])).select("asset_id"))
    return messages.join(assets.distinct(), "asset_id", "left_semi")


def book_snapshot(messages: DataFrame, event: str = "book") -> DataFrame:
    """The latest message of that type of each asset."""
    return messages.where(F.col("event_type") == event).groupBy("asset_id").agg(F.max_by(F.struct("received_at", "seq", "message"), F.struct("received_at", "seq")).alias("m")).select("asset_id", "m.*")


def live_book_snapshot(stream: DataFrame, path: str, checkpoint: str, event: str = "book", seconds: float | None = None, compact: int = 50) -> DataFrame:
    """book_snapshot of a stream of messages, kept at path while it runs; returns the snapshot as it is then.

    The stream's state has the latest message of each asset; a micro-batch's changed assets go to the batch's own folder,
    so a batch that runs again after a failure leaves the same snapshot. seconds as for record_stream.
    """
    latest = book_snapshot(stream, event)
    held = LatestRows(stream.sparkSession, path, latest.schema, ["asset_id"], ["received_at", "seq"], compact)
    _run(latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: held.write(rows, batch)), seconds)
    return held.read()


def stream_trades_dedupe(trades: DataFrame, columns: Sequence[str], delay: str = "1 hour") -> DataFrame:
    return trades.withWatermark("timestamp_utc", delay).dropDuplicatesWithinWatermark(list(columns))


def stream_bars(trades: DataFrame, step: int, delay: str = "1 hour", keys: Sequence[str] = ("market_id", "outcome")) -> DataFrame:
    """Bars with trades as windows close; stream_filled_bars has the empty ones too. end_of_input closes the last ones."""
    order = F.struct("timestamp_utc", "seq")
    grouped = trades.withWatermark("timestamp_utc", delay).groupBy(*keys, F.window("timestamp_utc", f"{step} seconds").alias("w"))
    return grouped.agg(
        F.count("*").alias("n_trades"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("notional"), F.min_by("price", order).alias("price_start"), F.max_by("price", order).alias("price_end"),
    ).select(*keys, F.col("w.start").alias("bar_start"), "n_trades", "volume", "notional", "price_start", "price_end")


def stream_filled_bars(trades: DataFrame, step: int, path: str, checkpoint: str, delay: str = "1 hour", keys: Sequence[str] = ("market_id", "outcome"), seconds: float | None = None, compact: int = 50) -> DataFrame:
    """stream_bars with the empty bars between, each written once, in order of time; returns what is at path then.

    The last closed bar of each key is kept beside the bars. A micro-batch's closed bars are filled from there on, and go to
    the batch's own folder, as do its last bars; a batch that runs again reads those of earlier batches only. The stream's
    session has no adaptive plans, where each of a batch's few bars' shuffles would be tasks for all state partitions, so
    closed bars are read by the caller's.
    """
    spark, keys = trades.sparkSession, list(keys)
    closed = stream_bars(trades, step, delay, keys)
    ends = closed.select(*keys, "bar_start")
    last = LatestRows(spark, f"{path}/last", ends.schema, keys, ["bar_start"], compact)

    def fill(bars: DataFrame, batch: int) -> None:
        bars = cut(bars, "closed-bars", spark)  # read for the bars, their keys and their ends
        key = F.struct(*keys)  # null equal to null
        before = last.read(batch).withColumn("__k", key).join(bars.select(key.alias("__k")).distinct(), "__k", "left_semi").drop("__k")
        before = before.select(*[F.col(f.name) if f.name in (*keys, "bar_start") else F.lit(None).cast(f.dataType).alias(f.name) for f in bars.schema])
        both = bars.withColumn("__new", F.lit(1)).unionByName(before.withColumn("__new", F.lit(0)))
        numbered = fill_bars(both.withColumn("__made", F.lit(1)), step, keys, ["n_trades", "volume", "notional", "__made"])
        kept = numbered.where("__new = 1 OR __made = 0").drop("__new", "__made")
        kept.write.mode("overwrite").parquet(f"{path}/bars/batch={batch}")
        last.write(bars.select(*keys, "bar_start"), batch)

    _run(closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(fill), seconds)
    return spark.read.schema(T.StructType([*closed.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/bars").drop("batch")


def end_of_input(spark: SparkSession, path: str, schema: T.StructType, time: str, after: int) -> None:
    """Adds a row to the streamed folder, null but for its time: so many seconds after the latest row there.

    Where after is the delay and a window's length, the next run of the stream passes the end of every window with rows,
    and the added row's own window stays open. All other rows must have been read by then; later ones count as late.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    latest = spark.read.schema(schema).parquet(path).agg(F.max(time).alias("latest")).where("latest IS NOT NULL")
    row = [(F.col("latest") + F.make_dt_interval(secs=F.lit(after)) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    latest.select(*row).write.mode("append").parquet(path)


def _run(writer: DataStreamWriter, seconds: float | None) -> None:
    """Runs a stream over all there is now, or for a time."""
    if seconds is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.start()
    query.awaitTermination(seconds)
    query.stop()


class _Counter(StreamingQueryListener):
    """Says when a query, by its run, has recorded so many rows, or has ended. Rows are counted by a metric of each micro-batch."""

    def __init__(self, name: str, most: int) -> None:
        self.name, self.most, self.rows, self.enough = name, most, 0, Event()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.rows += found["n"]
            if self.rows >= self.most:
                self.enough.set()

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


def record_stream(stream: DataFrame, path: str, checkpoint: str, seconds: float | None = None, most: int | None = None) -> DataFrame:
    """Writes a stream to Parquet and returns what was recorded: all there is now, or what comes within the time.

    most: the stream stops at the end of the micro-batch that brings its rows to that number, or at the time, whichever is
    first; of a recording of more the first rows by (received_at, seq) count. What earlier runs recorded at path counts too.
    """
    spark = stream.sparkSession
    held = lambda: spark.read.schema(stream.schema).parquet(path)
    if most is None:
        _run(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint), seconds)
        return held()
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)  # so that it can be read
    earlier = held().count()
    if earlier < most:
        name = f"recorded-{uuid4().hex}"
        counter = _Counter(name, most - earlier)
        writer = stream.observe(name, F.count(F.lit(1)).alias("n")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        spark.streams.addListener(counter)
        try:
            query = (writer.trigger(availableNow=True) if seconds is None else writer).start()
            deadline = None if seconds is None else monotonic() + seconds
            while query.isActive and not counter.enough.wait(0.05):
                if deadline is not None and monotonic() >= deadline:
                    break
            query.stop()
            if query.exception() is not None:
                raise query.exception()
        finally:
            spark.streams.removeListener(counter)
    return held().orderBy("received_at", "seq").limit(most)
