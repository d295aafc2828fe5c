"""Structural breaks: bars where price and volume move together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import parse_span
from ..scratch import cut
from . import bars as B
from .tables import exact_quantiles


@dataclass(frozen=True)
class BreakConfig:
    """Rules of the detector; percentages for prices, ratios to the baseline for volumes. Names and defaults are fixed values of the data model."""

    interval: str = "15min"
    baseline_window: int = 96
    baseline_min_periods: int = 24
    outcome: str | None = None
    auto_select_outcome: bool = True
    price_change_pct: float = 2.0
    strong_price_change_pct: float = 4.0
    volume_surge_ratio: float = 2.0
    volume_substantial_ratio: float = 0.8
    low_volume_ratio: float = 0.35
    min_volume_absolute: float | None = None
    min_trades_per_interval: int = 1
    min_break_score: float | None = None
    max_breaks: int | None = None
    break_radius: str | None = "3h"
    merge_consecutive_breaks: bool = True
    merge_gap_intervals: int = 1

    @property
    def step(self) -> int:
        step = parse_span(self.interval)
        if not step:
            raise ValueError(f"no interval: {self.interval!r}")
        return step


#: Fixed values of the data model: what a break's reason says.
SURGE, STRONG, NONE = "volume_surge_and_price_shift", "substantial_volume_and_strong_price_shift", "none"


def score_bars(bars: DataFrame, c: BreakConfig, by_market: bool = False) -> DataFrame:
    """Adds is_break, break_reason and break_score; where a value is missing no rule holds.

    by_market: the price and surge rules are columns of bars, under the config's names, so that each market has its own.
    """

    def rule(name: str) -> Column:
        return F.col(name) if by_market else F.lit(getattr(c, name))

    move, strong_move = F.col("abs_price_return_pct"), rule("strong_price_change_pct")
    traded = F.col("n_trades") >= c.min_trades_per_interval
    surge = F.coalesce(traded & (F.col("volume_ratio") >= rule("volume_surge_ratio")) & (move >= rule("price_change_pct")), F.lit(False))
    strong = F.coalesce(traded & F.col("volume_substantial") & (move >= strong_move), F.lit(False))
    score = move / F.greatest(strong_move, F.lit(1e-9)) * (1 + F.log1p(F.greatest(F.col("volume_ratio_signal"), F.lit(0.0))))
    return bars.withColumns({"is_break": (surge | strong) & ~F.col("volume_low"), "break_reason": F.when(surge, SURGE).when(strong, STRONG).otherwise(NONE), "break_score": score})


def merge_neighbors(bars: DataFrame, gap: int = 1, keys: Sequence[str] = B.KEYS) -> DataFrame:
    """Of breaks whose bars are at most gap places apart, one after another, the best-scored; the first where scores tie."""
    series = Window.partitionBy(*keys).orderBy("bar_start")
    at = bars.withColumn("__at", F.row_number().over(series)).where("is_break")
    apart = F.coalesce((F.col("__at") - F.lag("__at").over(series) > max(1, gap)).cast("int"), F.lit(0))
    grouped = at.withColumn("__apart", apart).withColumn("__cluster", F.sum("__apart").over(series))
    best = F.row_number().over(Window.partitionBy(*keys, "__cluster").orderBy(F.col("break_score").desc(), "bar_start"))
    return grouped.withColumn("__best", best).where("__best = 1").drop("__at", "__apart", "__cluster", "__best")


#: Breaks of a run without a longer gap up to which it is thinned in one row; longer runs are thinned in rounds.
FOLD = 256


def radius_nms(breaks: DataFrame, radius: int | None, keys: Sequence[str] = B.KEYS, fold: int = FOLD) -> DataFrame:
    """Keeps a break if it is farther than radius seconds from every stronger one kept; a missing value is the weakest.

    Time is cut into buckets of the radius, so a break can only meet those of its own bucket and the two beside it, and a
    bucket keeps one at most. Runs of buckets with a break each, of fold breaks at most, are thinned in a row each. In longer
    ones the buckets' strongest breaks that no stronger one left is near to are kept, their neighbours go, and so on while
    any are left: each round is a table. The rounds grow with the longest chain of ever stronger neighbours.
    """
    if not radius or radius <= 0:
        return breaks
    t = F.unix_micros("bar_start")
    key = F.struct(*[F.col(k) for k in keys]).alias("key")
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))
    strength = F.struct(value("break_score").alias("s"), value("abs_price_return_pct").alias("r"), value("volume_ratio_signal").alias("v"), (-t).alias("t"))
    held = cut(breaks, "breaks")
    left = held.select(key, F.floor(t / (radius * 1_000_000)).alias("bucket"), t.alias("t"), strength.alias("x"))
    by_key = Window.partitionBy("key").orderBy("bucket")
    runs = left.groupBy("key", "bucket").agg(F.count("*").alias("n")).withColumn("far", F.coalesce((F.col("bucket") - F.lag("bucket").over(by_key) > 1).cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("far").over(by_key)).withColumn("n", F.sum("n").over(Window.partitionBy("key", "run")))
    left = cut(left.join(runs.select("key", "bucket", "run", "n"), ["key", "bucket"]), "runs")
    near = lambda a, b: F.abs(a - b) <= radius * 1_000_000
    ranked = left.where(F.col("n") <= fold).groupBy("key", "run").agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("x"))
    first = F.aggregate("x", F.array().cast("array<bigint>"), lambda acc, e: F.when(F.exists(acc, lambda s: near(s, -e["t"])), acc).otherwise(F.array_append(acc, -e["t"])))
    kept = ranked.select("key", F.explode(first).alias("t"))
    left = left.where(F.col("n") > fold).select("key", "bucket", "t", "x")
    while not left.isEmpty():
        best = left.groupBy("key", "bucket").agg(F.max("x").alias("x"))
        beside = best.select("key", F.explode(F.array(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"), F.col("bucket").alias("own"), F.col("x").alias("mine"))
        beaten = left.join(beside, ["key", "bucket"]).where((F.col("x") > F.col("mine")) & near(F.col("t"), -F.col("mine.t"))).select("key", F.col("own").alias("bucket")).distinct()
        won = cut(best.join(beaten, ["key", "bucket"], "left_anti").select("key", "bucket", (-F.col("x.t")).alias("won")), "won")
        around = won.select("key", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("b"), "won").withColumnRenamed("key", "k")
        left = cut(left.join(around, (F.col("key") == F.col("k")) & (F.col("bucket") == F.col("b")) & near(F.col("t"), F.col("won")), "left_anti"), "left")
        kept = kept.unionByName(won.select("key", F.col("won").alias("t")))
    times = kept.select(*[F.col("key").getField(k).alias(k) for k in keys], F.timestamp_micros("t").alias("bar_start"))
    same = [held[c].eqNullSafe(times[c]) for c in (*keys, "bar_start")]
    return held.join(times, _all(same), "left_semi")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def _strongest(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(F.col("break_score").desc_nulls_last(), F.col("abs_price_return_pct").desc_nulls_last(), F.col("volume_ratio_signal").desc_nulls_last(), "bar_start")


def cap_breaks(breaks: DataFrame, most: int | str | None, keys: Sequence[str] = B.KEYS) -> DataFrame:
    """The strongest breaks of each key, at least one, with score_threshold: the least score kept.

    most is a number or a column with one; None keeps all, with a null threshold.
    """
    if most is None:
        return breaks.withColumn("score_threshold", F.lit(None).cast("double"))
    kept = breaks.withColumn("__place", F.row_number().over(_strongest(keys))).where(F.col("__place") <= F.greatest(F.lit(1), F.col(most) if isinstance(most, str) else F.lit(most))).drop("__place")
    return kept.withColumn("score_threshold", F.min("break_score").over(Window.partitionBy(*keys)))


def top_breaks(breaks: DataFrame, n: int, keys: Sequence[str] = B.KEYS) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("break_score").desc_nulls_last(), "bar_start")
    return breaks.withColumn("__place", F.row_number().over(best)).where(F.col("__place") <= n).drop("__place")


def break_table(breaks: DataFrame, keys: Sequence[str] = B.KEYS) -> DataFrame:
    return breaks.select(
        *keys, F.col("bar_start").alias("break_timestamp"), F.col("break_reason").alias("reason"), F.col("break_score").alias("score"), "price_end", "price_return_pct",
        "abs_price_return_pct", "volume", "volume_baseline", "volume_ratio", "n_trades",
    )


STATS = {"score_min": 0.0, "score_q50": 0.5, "score_q75": 0.75, "score_q90": 0.9, "score_q95": 0.95, "score_q99": 0.99, "score_max": 1.0}


def score_stats(breaks: DataFrame, keys: Sequence[str] = B.KEYS) -> DataFrame:
    """Quantiles of the scores of each key, by selection; a key without a score has no row."""
    return exact_quantiles(breaks, keys, {name: (F.col("break_score"), f) for name, f in STATS.items()})


def score_histogram(breaks: DataFrame, bins: int = 60) -> DataFrame:
    """Counts of scores in equal bins up to the 99.5 % quantile (the largest score where that isn't above 0); higher ones go to the last bin.

    The scores are written once, for the limits and the counts.
    """
    held = cut(breaks.select("break_score").where("break_score IS NOT NULL"), "scores")
    ends = exact_quantiles(held, [], {"low": (F.col("break_score"), 0.0), "q": (F.col("break_score"), 0.995), "most": (F.col("break_score"), 1.0)})
    held = held.withColumn("limits", ends.select(F.struct("low", "q", "most")).scalar())
    held = held.withColumns({"low": F.col("limits.low"), "high": F.when(F.col("limits.q") > 0, F.col("limits.q")).otherwise(F.col("limits.most"))})
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.least("break_score", "high") - F.col("low")) / (F.col("high") - F.col("low")) * bins)))
    return held.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("break_score") > F.col("high")).alias("n_above"))


@dataclass
class Breaks:
    """bars (a table), candidates (before the cap), breaks (after it) and a summary row a key."""

    bars: DataFrame
    candidates: DataFrame
    breaks: DataFrame
    summary: DataFrame


def break_bars(trades: DataFrame, c: BreakConfig, keys: Sequence[str] = B.KEYS) -> DataFrame:
    """Bars with every column of the detector."""
    clean = B.clean_trades(trades)
    if c.outcome is not None:
        clean = B.filter_outcome(clean, c.outcome)
    elif c.auto_select_outcome and "outcome" in keys:
        clean = B.top_outcome(clean)
    bars = B.rolling_quantiles(B.bar_returns(B.ohlc_bars(clean, c.step, keys)), c.baseline_window, c.baseline_min_periods, keys)
    bars = bars.withColumn("price_plot", B.forward_fill("price_end", keys))
    return score_bars(B.volume_flags(B.volume_ratio(bars), c.volume_substantial_ratio, c.low_volume_ratio, c.min_volume_absolute), c)


def detect_breaks(trades: DataFrame, c: BreakConfig | None = None, keys: Sequence[str] = B.KEYS) -> Breaks:
    c = c or BreakConfig()
    bars = cut(break_bars(trades, c, keys), "bars")  # read for the breaks and, more than once, for the summary
    found = merge_neighbors(bars, c.merge_gap_intervals, keys) if c.merge_consecutive_breaks else bars.where("is_break")
    if c.min_break_score is not None:
        found = found.where(F.col("break_score") >= c.min_break_score)
    candidates = radius_nms(found, parse_span(c.break_radius), keys)
    breaks = cap_breaks(candidates, c.max_breaks, keys)
    return Breaks(bars, candidates, breaks, break_summary(bars, candidates, breaks, c, keys))


def break_summary(bars: DataFrame, candidates: DataFrame, breaks: DataFrame, c: BreakConfig, keys: Sequence[str] = B.KEYS) -> DataFrame:
    """One row a key: counts, the rules, the threshold, medians and score quantiles."""
    medians = exact_quantiles(bars, keys, {"median_abs_return_pct": (F.col("abs_price_return_pct"), 0.5), "median_volume_ratio": (F.col("volume_ratio"), 0.5)})
    base = bars.groupBy(*keys).agg(F.count("*").alias("n_intervals")).join(medians, list(keys), "left")
    before = candidates.groupBy(*keys).agg(F.count("*").alias("n_candidates_before_cap"))
    after = breaks.groupBy(*keys).agg(F.count("*").alias("n_breaks"), F.min("score_threshold").alias("score_threshold_selected"))
    out = base.join(before, list(keys), "left").join(after, list(keys), "left").join(score_stats(candidates, keys), list(keys), "left")
    rules = {n: F.lit(getattr(c, n)).cast("double") for n in ("price_change_pct", "strong_price_change_pct", "volume_surge_ratio", "volume_substantial_ratio", "low_volume_ratio", "min_break_score")}
    rules |= {"interval": F.lit(c.interval), "break_radius": F.lit(c.break_radius).cast("string"), "max_breaks": F.lit(c.max_breaks).cast("int")}
    return out.withColumns(rules).fillna(0, ["n_candidates_before_cap", "n_breaks"])


def overview_series(bars: DataFrame, price_span: int = 32, volume_span: int = 32, clip: float = 0.995, keys: Sequence[str] = B.KEYS) -> DataFrame:
    """Smoothed price, volume and baseline, volumes clipped at a quantile (between 0.90 and 1) of the smoothed volume."""
    out = B.ewma(bars, "price_plot", max(2, price_span), "price_smooth", keys)
    out = B.ewma(out, "volume", max(2, volume_span), "volume_smooth", keys)
    out = B.ewma(out, "volume_baseline", max(2, volume_span), "baseline_smooth", keys)
    out = cut(out, "smoothed")
    volume = F.col("volume_smooth")
    limit = exact_quantiles(out, keys, {"__q": (volume, min(max(clip, 0.9), 1.0)), "__most": (volume, 1.0)})
    out = out.join(limit, list(keys), "left").withColumn("__limit", F.when(F.col("__q") > 0, F.col("__q")).otherwise(F.col("__most")))
    clipped = lambda name: F.when(F.col("__limit") > 0, F.least(name, "__limit")).otherwise(F.col(name))
    clipped_or_null = F.when(F.col("baseline_smooth").isNotNull(), clipped("baseline_smooth"))
    return out.select(*keys, "bar_start", F.col("price_plot").alias("price_raw"), "price_smooth", clipped("volume_smooth").alias("volume_plot"), clipped_or_null.alias("baseline_plot"))


#: Pairs of rows and breaks that a task of near_breaks makes; buckets of more are split.
PAIRS = 5_000_000


def near_breaks(rows: DataFrame, time_col: str, breaks: DataFrame, seconds: int, keys: Sequence[str] = (), pairs: int = PAIRS) -> DataFrame:
    """Rows within that many seconds of a break, both ends included, once for each such break (break_timestamp).

    Both sides are cut into buckets of that length and each break goes to its own bucket and the two beside it, so the
    join is on equal keys and buckets, and the exact test runs on those pairs. Before it, rows outside of all breaks' windows
    in their bucket go. A bucket whose rows and breaks make more than so many pairs is split by its rows, whose breaks are
    copied; of such buckets there are no more than all pairs divided by that number, so their list is broadcast.
    """
    span = seconds * 1_000_000
    at, time = ["__key", "__bucket"], F.unix_micros(time_col)
    key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__0")).alias("__key")
    around = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: d + F.floor(F.unix_micros("bar_start") / span))).alias("__bucket")
    right = breaks.select(key, F.unix_micros("bar_start").alias("__at"), F.col("bar_start").alias("break_timestamp"), around)
    reached = right.groupBy(*at).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.count("*").alias("__breaks"))
    left = rows.select("*", key, F.floor(time / span).alias("__bucket")).join(reached, at).where((time >= F.col("__first") - span) & (time <= F.col("__last") + span)).drop("__first", "__last")
    parts = left.groupBy(*at).agg(F.ceil(F.count("*") * F.first("__breaks") / pairs).cast("int").alias("__parts")).where("__parts > 1")
    split = F.coalesce("__parts", F.lit(1))
    left = left.drop("__breaks").join(F.broadcast(parts), at, "left").withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), split)).drop("__parts")
    right = right.join(F.broadcast(parts), at, "left").select(*at, "__at", "break_timestamp", F.explode(F.sequence(F.lit(0).cast("bigint"), (split - 1).cast("bigint"))).alias("__part"))
    return left.join(right, [*at, "__part"]).where(F.abs(time - F.col("__at")) <= span).drop(*at, "__part", "__at")


def price_at_breaks(breaks: DataFrame, bars: DataFrame, column: str = "price_plot", keys: Sequence[str] = B.KEYS) -> DataFrame:
    """The bar's price at each break's time; where it has none, the last one before in the list of breaks, else the next."""
    named = bars.select(*keys, "bar_start", F.col(column).alias("price_at_break"))
    both = breaks.select(*keys, "bar_start").join(named, [*keys, "bar_start"], "left")
    return both.withColumn("price_at_break", B.forward_backward_fill("price_at_break", keys))
