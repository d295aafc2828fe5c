"""The engine's public compositions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import breaks as K
from ..operators import fills as L
from ..operators import markets as M
from ..operators import news as N
from ..operators.tables import dedupe_rows, snake_case_columns, task_partitions
from ..scratch import cut
from ..streaming import orderbook as S

HOUR = 3600
TRADE_COLUMNS = ["timestamp_utc", "price", "size", "outcome", "transaction_hash"]


def trades_from_fills(fills: DataFrame, markets: DataFrame, start: str | None = None, dedupe_key: str | None = None) -> DataFrame:
    """Typed trades of all markets: by asset, from a start, scaled by market, deduplicated, in order of market and time.

    dedupe_key="seq" keeps equal fills of one transaction apart. Equal times go by transaction and seq. Trades are counted, so
    that no task gets more of them to sort for a larger table.
    """
    trades = L.normalize_fills_for_asset(fills, L.market_tokens(markets))
    if start is not None:
        trades = B.filter_start_date(trades, start)
    trades = cut(trades, "typed-trades")
    columns = ["market_id", dedupe_key] if dedupe_key else ["market_id", *TRADE_COLUMNS]
    dealt = L.normalize_size(trades, written=True).repartition(task_partitions(trades, trades.count()), *columns)
    trades = dedupe_rows(dealt, columns)
    return B.sort_trades(trades, ["market_id"])


@dataclass
class MarketMeta:
    markets: DataFrame
    summary: DataFrame
    top_markets: DataFrame


def market_meta(active: DataFrame, inactive: DataFrame, top_n: int = 25, min_created_at: str | None = None, **limits: float) -> MarketMeta:
    both = snake_case_columns(M.filter_created_at(M.union_markets(active, inactive), min_created_at))
    markets = M.dedupe_markets(both, F.col("state_order"), F.col("created_at"), F.col("slug"))
    return MarketMeta(M.sort_markets(markets), M.summarize_markets(markets), M.rank_markets(markets, top_n, **limits))


def news_search(raw: DataFrame, start: str, end: str, language: str | None = None, most: int | None = None) -> DataFrame:
    """Articles of a window in a language, one of each key (the newest), at most that many, in order of time."""
    found = N.dedupe_articles(N.filter_language(N.filter_news_window(N.normalize_articles(raw), start, end), language), keep="newest")
    if most is not None:
        found = found.orderBy(F.col("timestamp_utc").desc(), F.col("url").asc_nulls_last(), F.col("title").asc_nulls_last()).limit(most)
    return N.sort_news(found)


def record_orderbook(stream: DataFrame, tokens: DataFrame, condition_ids: list[str], path: str, checkpoint: str, seconds: float | None = None) -> DataFrame:
    return S.record_stream(S.subscribe_filter(S.message_envelope(stream), tokens, condition_ids), path, checkpoint, seconds)


@dataclass
class Report:
    """A market's liquidity with its regime, its breaks under that regime's rules, and the bars and news around the strongest."""

    stats: DataFrame
    bars: DataFrame
    breaks: DataFrame
    bars_around: DataFrame
    news_around: DataFrame


def break_report(trades: DataFrame, articles: DataFrame, cutoff: str, interval: str = "1h", top: int = 5, language: str | None = "english") -> Report:
    """Every market is judged by the rules of its own liquidity after the cutoff. Statistics, bars and breaks are written once, for what reads them."""
    config = K.BreakConfig(interval=interval, low_volume_ratio=0.40, min_trades_per_interval=2, merge_gap_intervals=2)
    after = cut(B.top_outcome(B.clean_trades(B.filter_start_date(trades, cutoff))), "trades-after")  # read for the statistics and for the bars
    stats = B.adaptive_thresholds(B.adaptive_smoothing(B.liquidity_stats(after, config.step), config.step))
    stats = cut(stats, "stats")
    rules = ["price_change_pct", "strong_price_change_pct", "volume_surge_ratio", "volume_substantial_ratio", "max_breaks"]
    bars = K.break_bars(after, config).drop("volume_substantial", "volume_low", "is_break", "break_reason", "break_score").join(stats.select(*B.KEYS, *rules), list(B.KEYS))
    bars = cut(K.score_bars(B.volume_flags(bars, F.col("volume_substantial_ratio"), config.low_volume_ratio), config, by_market=True), "bars")
    found = cut(K.cap_breaks(K.radius_nms(K.merge_neighbors(bars, config.merge_gap_intervals), 3 * HOUR), "max_breaks").drop(*rules), "breaks")
    bars = bars.drop(*rules)
    best = K.top_breaks(found, top)
    first = K.top_breaks(found, 1)
    return Report(stats, bars, found, K.near_breaks(bars, "bar_start", best, 12 * HOUR, B.KEYS), K.near_breaks(N.filter_language(articles, language), "timestamp_utc", first, 6 * HOUR))
