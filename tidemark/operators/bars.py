"""Time bars of trades and the window columns over them. All operators are keyed, so that all markets run in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.values import number
from ..scratch import cut
from .series import ewma_by_segments, filled_forward, lagged
from .tables import exact_quantiles

KEYS = ("market_id", "outcome")
DAY = 86_400


def clean_trades(trades: DataFrame) -> DataFrame:
    """Typed trades with a time, a price and a size; blank outcomes become null."""
    typed = trades.withColumns({"timestamp_utc": F.col("timestamp_utc").try_cast("timestamp"), "price": number(F.col("price")), "size": number(F.col("size"))})
    if "outcome" in trades.columns:
        typed = typed.withColumn("outcome", F.nullif(strip(F.col("outcome")), F.lit("")))
    return typed.dropna(subset=["timestamp_utc", "price", "size"])


def notional(trades: DataFrame) -> DataFrame:
    """Adds notional, the price times the size; null without either."""
    return trades.withColumn("notional", F.col("price") * F.col("size"))


def filter_start_date(trades: DataFrame, start: str) -> DataFrame:
    """Trades from a time on, itself included; those without a time go."""
    return trades.where(F.col("timestamp_utc") >= F.lit(start).cast("timestamp"))


def split_cutoff(trades: DataFrame, cutoff: str) -> DataFrame:
    """Adds before: whether a trade comes before the cutoff; null without a time."""
    return trades.withColumn("before", F.col("timestamp_utc") < F.lit(cutoff).cast("timestamp"))


def sort_trades(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """In order of the keys, then of time and, where times are equal, of the transaction, if there is one, and of seq."""
    order = [F.col(c) for c in ("transaction_hash", "seq") if c in trades.columns] if keys else [F.col("seq")]
    return trades.orderBy(*keys, F.col("timestamp_utc").asc_nulls_last(), *order)


def filter_outcome(trades: DataFrame, outcome: str) -> DataFrame:
    """Trades of one outcome, whatever its case. ValueError with the outcomes there are, if it has none."""
    wanted = outcome.strip().lower()
    found = trades.where(F.lower(strip(F.col("outcome"))) == wanted)
    if found.isEmpty():
        there = [r[0] for r in trades.select("outcome").distinct().where("outcome IS NOT NULL").orderBy("outcome").limit(50).collect()]
        raise ValueError(f"no trades of outcome {outcome!r}; there are {there}")
    return found


def top_outcome(trades: DataFrame) -> DataFrame:
    """Trades of each market's outcome of largest total size; all trades of markets without outcomes."""
    totals = trades.where("outcome IS NOT NULL").groupBy("market_id", "outcome").agg(F.sum("size").alias("total"))
    best = totals.groupBy("market_id").agg(F.min_by("outcome", F.struct((-F.coalesce("total", F.lit(0.0))).alias("t"), "outcome")).alias("best"))
    return trades.join(best, "market_id", "left").where("best IS NULL OR outcome = best").drop("best")


def with_bar_start(trades: DataFrame, step: int, keys: Sequence[str]) -> DataFrame:
    """Adds bar_start: bars count from the midnight before a key's first trade, which is the epoch's grid where step divides a day."""
    second = F.unix_micros("timestamp_utc") / 1_000_000
    if DAY % step == 0:
        return trades.withColumn("bar_start", F.timestamp_seconds(F.floor(second / step) * step))
    origin = trades.groupBy(*keys).agg(F.unix_timestamp(F.date_trunc("day", F.min("timestamp_utc"))).alias("__origin"))
    placed = trades.join(origin, list(keys))
    return placed.withColumn("bar_start", F.timestamp_seconds(F.col("__origin") + F.floor((second - F.col("__origin")) / step) * step)).drop("__origin")


#: Empty bars that one row makes; longer gaps are made of several.
CHUNK = 100_000


def fill_bars(bars: DataFrame, step: int, keys: Sequence[str], zeros: Sequence[str], most_bars: int | None = None) -> DataFrame:
    """Adds the empty bars between a key's first and last: each bar makes those up to the next one, with no second pass or join.

    A gap is cut into chunks before its bars are made, so no row holds a long one. most_bars: an error for gaps of more.
    """
    ahead = F.lead(F.unix_seconds("bar_start")).over(Window.partitionBy(*keys).orderBy("bar_start"))
    n = F.coalesce(F.floor((ahead - F.unix_seconds("bar_start")) / step), F.lit(1))
    if most_bars is not None:
        n = F.when(n - 1 > most_bars, F.raise_error(F.lit("too many empty bars between two trades; take a longer interval")).cast("bigint")).otherwise(n)
    spread = bars.withColumn("__n", n).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / CHUNK))))
    spread = spread.withColumn("__k", F.explode(F.sequence(F.col("__chunk") * CHUNK, F.least(F.col("__chunk") * CHUNK + CHUNK, "__n") - 1)))
    here = F.col("__k") == 0
    out = [F.when(here, F.col(c)).otherwise(F.lit(0)).cast(bars.schema[c].dataType).alias(c) if c in zeros else F.when(here, F.col(c)).alias(c) for c in bars.columns if c not in (*keys, "bar_start")]
    return spread.select(*keys, F.timestamp_seconds(F.unix_seconds("bar_start") + F.col("__k") * step).alias("bar_start"), *out)


def ohlc_bars(trades: DataFrame, step: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trade count, volume, notional, first and last price of each interval of step seconds, empty intervals included.

    First and last go by (time, seq), so that equal times have a defined order.
    """
    order = F.struct("timestamp_utc", "seq")
    bars = with_bar_start(trades, step, keys).groupBy(*keys, "bar_start").agg(
        F.count("*").alias("n_trades"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("notional"),
        F.min_by("price", order).alias("price_start"), F.max_by("price", order).alias("price_end"),
    )
    return fill_bars(bars, step, keys, ("n_trades", "volume", "notional"))


def usd_volume_buckets(trades: DataFrame, step: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return ohlc_bars(trades, step, keys).select(*keys, "bar_start", "n_trades", "volume", F.col("notional").alias("usd_volume"))


def liquidity_buckets(trades: DataFrame, step: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Buckets with the last price and the mean price; the mean goes on over empty buckets."""
    bars = with_bar_start(trades, step, keys).groupBy(*keys, "bar_start").agg(
        F.count("*").alias("n_trades"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("usd_volume"),
        F.max_by("price", F.struct("timestamp_utc", "seq")).alias("price_end"), F.avg("price").alias("price_avg"),
    )
    filled = fill_bars(bars, step, keys, ("n_trades", "volume", "usd_volume"))
    return filled.withColumn("price_avg", forward_backward_fill("price_avg", keys))


def _series(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("bar_start")


def forward_fill(column: str, keys: Sequence[str] = KEYS) -> Column:
    return F.last(column, ignorenulls=True).over(_series(keys).rowsBetween(Window.unboundedPreceding, 0))


def forward_backward_fill(column: str, keys: Sequence[str] = KEYS) -> Column:
    """The way back is a running window too, in reverse order: a frame that ends at the last row would be folded anew for each row."""
    back = Window.partitionBy(*keys).orderBy(F.col("bar_start").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(forward_fill(column, keys), F.last(column, ignorenulls=True).over(back))


def rolling_quantiles(bars: DataFrame, window: int = 96, least: int = 24, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds volume_baseline, volume_q50 and volume_q75 over the bars before; null where there are fewer than least."""
    frame = _series(keys).rowsBetween(-window, -1)
    both = F.percentile("volume", F.array(F.lit(0.5), F.lit(0.75))).over(frame)
    out = bars.withColumns({"__q": both, "__n": F.count("volume").over(frame)}).withColumn("__q", F.when(F.col("__n") >= least, F.col("__q")))
    q50, q75 = F.col("__q")[0], F.col("__q")[1]
    return out.withColumns({"volume_baseline": q50, "volume_q50": q50, "volume_q75": q75}).drop("__q", "__n")


def bar_returns(bars: DataFrame) -> DataFrame:
    """Adds price_return_pct, null without both prices or from 0, and its absolute value."""
    value = (F.try_divide("price_end", "price_start") - 1) * 100
    return bars.withColumn("price_return_pct", value).withColumn("abs_price_return_pct", F.abs("price_return_pct"))


def volume_ratio(bars: DataFrame) -> DataFrame:
    """Adds volume_ratio to the baseline (null without one, or from 0) and volume_ratio_signal (0 where the ratio is null)."""
    return bars.withColumn("volume_ratio", F.try_divide("volume", "volume_baseline")).withColumn("volume_ratio_signal", F.coalesce("volume_ratio", F.lit(0.0)))


def volume_flags(bars: DataFrame, substantial: float | Column = 0.8, low: float = 0.35, absolute: float | None = None) -> DataFrame:
    """Adds volume_substantial and volume_low; a share of the baseline may be a column, so that each market has its own."""
    volume, signal = F.col("volume"), F.col("volume_ratio_signal")
    much = (signal >= substantial) | F.coalesce(volume >= F.col("volume_q75"), F.lit(False))
    if absolute is not None:
        much |= volume >= absolute
    little = (volume <= 0) | ((signal < low) & F.coalesce(volume < F.col("volume_q50"), F.lit(True)))
    return bars.withColumns({"volume_substantial": F.coalesce(much, F.lit(False)), "volume_low": F.coalesce(little, F.lit(True))})


#: Natural logarithm of the weight that a block of ewma's rows spans: what lies two blocks back weighs less than exp(-BLOCK_DECAY).
BLOCK_DECAY = 300.0


def fill_forward(df: DataFrame, column: str, out: str, keys: Sequence[str] = KEYS, order: str = "bar_start", segments: int | None = None) -> DataFrame:
    """Adds the last value up to each row that isn't null; segments as for ewma."""
    if segments:
        return filled_forward(df, column, out, keys, [order], segments)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def ewma(df: DataFrame, column: str, span: int, out: str, keys: Sequence[str] = KEYS, order: str = "bar_start", segments: int | None = None) -> DataFrame:
    """Exponentially weighted mean with weight a = 2 / (span + 1) on the newest value.

    Without segments a key's rows are one task's, which suits many keys; with a number of them rows are split by key and
    order into so many range partitions, however few keys there are.

    Leading nulls stay null, later ones keep the mean, and the old mean's weight goes on falling by (1 - a) with every
    row in between, missing or not: the mean after k rows is (q m + a x) / (q + a) with q = (1 - a) ** k.

    The recursion is solved by running sums, so rows hold no history. With L the running sum of the logarithms of the
    old mean's shares, a value's weight in a later mean is exp of the difference in L. Sums of value / exp(L) would
    overflow, so L is counted from the start of blocks of BLOCK_DECAY; a block and the one before it are all that weighs.
    """
    if segments:
        return ewma_by_segments(df, column, span, out, keys, [order], segments, BLOCK_DECAY)
    a = 2 / (span + 1)
    series = Window.partitionBy(*keys).orderBy(order)
    upto, before = series.rowsBetween(Window.unboundedPreceding, 0), series.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("__v")
    rows = df.withColumns({"__v": F.col(column).cast("double"), "__n": F.row_number().over(series)})
    rows = rows.withColumn("__was", F.last(F.when(v.isNotNull(), F.col("__n")), ignorenulls=True).over(before))
    q = F.pow(F.lit(1 - a), F.col("__n") - F.col("__was"))
    first = F.col("__was").isNull()
    rows = rows.withColumn("__share", F.when(v.isNotNull(), F.when(first, F.lit(1.0)).otherwise(F.lit(a) / (q + a))))
    if span <= 1:
        return rows.withColumn(out, F.last(v, ignorenulls=True).over(upto)).drop("__v", "__n", "__was", "__share")
    # After a very long gap the old mean's share is cut at exp(-4 * BLOCK_DECAY), which is nothing beside a new value.
    fall = F.when(v.isNull() | first, F.lit(0.0)).otherwise(F.greatest(F.log(q) - F.log(q + a), F.lit(-4 * BLOCK_DECAY)))
    rows = rows.withColumn("__log", F.sum(fall).over(upto))
    rows = rows.withColumn("__block", F.floor(-F.col("__log") / BLOCK_DECAY))
    rows = rows.withColumn("__in", F.col("__log") + F.col("__block") * BLOCK_DECAY)
    block = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum(F.col("__share") * v * F.exp(-F.col("__in"))).over(block))
    rows = rows.withColumns({"__last": F.lag("__sum").over(series), "__last_block": F.lag("__block").over(series)})
    held = F.first(F.struct("__last", "__last_block")).over(block)
    rows = rows.withColumn("__held", held)
    carried = F.coalesce(F.col("__held.__last") * F.exp(BLOCK_DECAY * (F.col("__held.__last_block") - F.col("__block"))), F.lit(0.0))
    mean = F.exp("__in") * (F.coalesce("__sum", F.lit(0.0)) + carried)
    rows = rows.withColumn(out, F.last(F.when(v.isNotNull(), mean), ignorenulls=True).over(upto))
    return rows.drop("__v", "__n", "__was", "__share", "__log", "__block", "__in", "__sum", "__last", "__last_block", "__held")


def inter_trade_seconds(trades: DataFrame, keys: Sequence[str] = ("market_id",), segments: int | None = None) -> DataFrame:
    """Adds the seconds since the key's trade before, null for its first; segments as for ewma."""
    at = F.unix_micros("timestamp_utc")
    if segments:
        rows = lagged(trades, at, "__before", keys, ["timestamp_utc", "seq"], segments)
    else:
        rows = trades.withColumn("__before", F.lag(at).over(Window.partitionBy(*keys).orderBy("timestamp_utc", "seq")))
    return rows.withColumn("inter_trade_seconds", (at - F.col("__before")) / 1_000_000).drop("__before")


def liquidity_stats(trades: DataFrame, step: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row a key: means and medians of USD volume and trades an interval, and of seconds between trades.

    Buckets and gaps are written once each; the means and the passes of the medians read them.
    """
    buckets = cut(usd_volume_buckets(trades, step, keys).select(*keys, "usd_volume", "n_trades"), "buckets")
    means = buckets.groupBy(*keys).agg(F.avg("usd_volume").alias("mean_usd_volume"), F.avg("n_trades").alias("mean_trades"))
    medians = exact_quantiles(buckets, keys, {"median_usd_volume": (F.col("usd_volume"), 0.5), "median_trades": (F.col("n_trades"), 0.5)})
    gaps, gap = cut(inter_trade_seconds(trades, keys).select(*keys, "inter_trade_seconds"), "gaps"), F.col("inter_trade_seconds")
    gap_means = gaps.groupBy(*keys).agg(F.avg(gap).alias("mean_gap"))
    gap_medians = exact_quantiles(gaps, keys, {"median_gap_raw": (gap, 0.5), "median_gap_nonzero": (F.when(gap > 0, gap), 0.5)})
    return means.join(medians, list(keys), "left").join(gap_means, list(keys)).join(gap_medians, list(keys), "left")


#: Fixed values of the data model: liquidity regimes, with hours of smoothing, then the detector's thresholds and cap.
REGIMES = [
    ("very low liquidity", 48, 3.5, 7.0, 2.8, 1.2, 8),
    ("low liquidity", 24, 3.0, 6.0, 2.5, 1.1, 10),
    ("medium liquidity", 12, 2.5, 5.0, 2.2, 1.0, 12),
    ("high liquidity", 6, 2.0, 4.0, 2.0, 0.9, 10),
]


def adaptive_smoothing(stats: DataFrame, step: int) -> DataFrame:
    """Adds regime and smoothing_span (in bars) from the median seconds between trades and median trades a bar."""
    gap, n = F.col("median_gap_nonzero"), F.col("median_trades")
    regime = F.when((gap > 180) | (n < 1.5), REGIMES[0][0]).when((gap > 90) | (n < 3), REGIMES[1][0]).when((gap > 30) | (n < 8), REGIMES[2][0]).otherwise(REGIMES[3][0])
    hours = F.coalesce(*[F.when(F.col("regime") == r[0], r[1]) for r in REGIMES])
    return stats.withColumn("regime", regime).withColumn("smoothing_span", F.greatest(F.lit(4), F.floor(hours * 3600 / step)).cast("int"))


def adaptive_thresholds(stats: DataFrame) -> DataFrame:
    """Adds the detector's thresholds and cap of each row's regime."""
    names = ["price_change_pct", "strong_price_change_pct", "volume_surge_ratio", "volume_substantial_ratio", "max_breaks"]
    return stats.withColumns({name: F.coalesce(*[F.when(F.col("regime") == r[0], F.lit(r[2 + k])) for r in REGIMES]) for k, name in enumerate(names)})


def align_to_bars(values: DataFrame, bars: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The value of each bar, 0 where values has none."""
    both = bars.select(*keys, "bar_start").join(values.select(*keys, "bar_start", column), [*keys, "bar_start"], "left")
    return both.withColumn(column, F.coalesce(column, F.lit(0.0)))
