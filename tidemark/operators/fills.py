"""Order fills and API trades to typed trades; token tables; size scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_list, epoch_ts, number
from ..scratch import cut
from .tables import exact_quantiles, small_side


def market_tokens(markets: DataFrame) -> DataFrame:
    """A row per token of each market: condition_id, asset_id, pos and outcome; outcomes go by position where there are as many as tokens."""
    tokens = F.array_distinct(F.filter(F.transform(as_list(F.col("clob_token_ids")), lambda x: F.trim(x)), lambda x: x != ""))
    names = F.transform(as_list(F.col("outcomes")), lambda x: F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.title"), F.get_json_object(x, "$.outcome"), x))
    paired = markets.select("condition_id", tokens.alias("tokens"), names.alias("names"))
    rows = paired.select("condition_id", F.size("tokens").alias("n"), "names", F.posexplode("tokens").alias("pos", "asset_id"))
    return rows.select("condition_id", "asset_id", "pos", F.when(F.size("names") == F.col("n"), F.get("names", "pos")).alias("outcome"))


def join_token_outcome(fills: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds outcome by asset_id; null for unknown assets."""
    return fills.join(tokens.select("asset_id", "outcome").dropDuplicates(["asset_id"]), "asset_id", "left")


def _fill_columns(fills: DataFrame) -> DataFrame:
    """id, time, hash, assets and amounts under one name each, whatever alias they come by. Token ids stay text."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in fills.columns], F.lit(None).cast("string"))
    return fills.select(
        pick("id").alias("id"), epoch_ts(*[F.col(c) for c in ("timestamp", "ts", "time", "created_at", "createdAt") if c in fills.columns]).alias("timestamp_utc"),
        pick("transactionHash", "transaction_hash", "hash").alias("transaction_hash"), pick("makerAssetId", "makerAssetID").alias("maker_asset"), pick("takerAssetId", "takerAssetID").alias("taker_asset"),
        number(pick("makerAmountFilled", "maker_amount_filled", "makerAmount", "maker_amount")).alias("maker_amount"),
        number(pick("takerAmountFilled", "taker_amount_filled", "takerAmount", "taker_amount")).alias("taker_amount"),
    )


def _price(quote: Column, shares: Column) -> Column:
    return F.try_divide(quote, shares)


def normalize_fills_for_asset(fills: DataFrame, tokens: DataFrame) -> DataFrame:
    """A trade row for each fill and each known asset on its sides; a fill between two known assets gives two.

    Shares are the asset side's amount, the quote is the other's, the price quote / shares. Where both sides are the
    same asset the maker side counts. Tokens are written and counted here and, if few, go out to the fills: half of all
    sides can be one asset, such as 0 for money.
    """
    typed = _fill_columns(fills).where(F.col("timestamp_utc").isNotNull())
    sides = F.array(F.struct(F.col("maker_asset").alias("asset_id"), F.col("maker_amount").alias("shares"), F.col("taker_amount").alias("quote")), F.struct(F.col("taker_asset").alias("asset_id"), F.col("taker_amount").alias("shares"), F.col("maker_amount").alias("quote")))
    both = F.when(F.col("maker_asset") == F.col("taker_asset"), F.slice(sides, 1, 1)).otherwise(sides)
    known = small_side(tokens.select("condition_id", "asset_id", "outcome").dropDuplicates(["condition_id", "asset_id"]), "tokens")
    rows = typed.select("id", "timestamp_utc", "transaction_hash", F.explode(both).alias("s")).select("id", "timestamp_utc", "transaction_hash", "s.*")
    return rows.join(known, "asset_id").select(
        F.col("condition_id").alias("market_id"), "asset_id", "timestamp_utc", _price(F.col("quote"), F.col("shares")).alias("price"), F.col("shares").alias("size"), "outcome", "transaction_hash", F.col("id").alias("seq"),
    )


def normalize_fills(fills: DataFrame, tokens: DataFrame) -> DataFrame:
    """A trade row for each fill. The outcome token is the maker's asset if known, else the taker's, else the side whose price lies in [0, 1.05], maker first."""
    typed = _fill_columns(fills).where(F.col("timestamp_utc").isNotNull())
    known = tokens.select("asset_id", "outcome").dropDuplicates(["asset_id"])
    maker, taker = (known.select(F.col("asset_id").alias(f"{s}_asset"), F.col("outcome").alias(f"{s}_outcome"), F.lit(True).alias(f"{s}_known")) for s in ("maker", "taker"))
    both = typed.join(maker, "maker_asset", "left").join(taker, "taker_asset", "left")
    likely = lambda q, s: F.coalesce(_price(F.col(q), F.col(s)).between(0, 1.05), F.lit(False))
    by_maker = F.when(F.col("maker_known"), True).when(F.col("taker_known"), False).otherwise(likely("taker_amount", "maker_amount") | ~likely("maker_amount", "taker_amount"))
    both = both.withColumn("by_maker", by_maker)
    shares, quote = F.when(F.col("by_maker"), F.col("maker_amount")).otherwise(F.col("taker_amount")), F.when(F.col("by_maker"), F.col("taker_amount")).otherwise(F.col("maker_amount"))
    outcome = F.when(F.col("maker_known"), F.col("maker_outcome")).when(F.col("taker_known"), F.col("taker_outcome"))
    return both.select("timestamp_utc", _price(quote, shares).alias("price"), shares.alias("size"), outcome.alias("outcome"), "transaction_hash", F.col("id").alias("seq"))


def normalize_trades(trades: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """API trades to trade rows, by the first alias with a value: 0 and blank text count as none, as for a truth test.

    Where no alias has a value, a 0 of the last one in the list stays: so a chain of truth tests ends.
    """
    names = set(trades.columns)

    def pick(*aliases: str) -> Column:
        held = {a: F.nullif(F.col(a).cast("string"), F.lit("")) for a in aliases if a in names}
        true = [F.when(F.coalesce(c.try_cast("double") != 0, F.lit(True)), c) for c in held.values()]
        return F.coalesce(*true, held.get(aliases[-1], F.lit(None).cast("string")))

    inner = {f.name for f in trades.schema["token"].dataType.fields} if "token" in names else set()
    nested = F.col("token.outcome").cast("string") if "outcome" in inner else F.lit(None).cast("string")
    rows = trades.select(
        epoch_ts(pick("timestamp", "ts", "time"), pick("created_at", "createdAt")).alias("timestamp_utc"), number(pick("price", "trade_price", "rate")).alias("price"), number(pick("size", "amount", "shares")).alias("size"),
        F.coalesce(pick("outcome", "outcome_id", "outcomeId"), nested).alias("outcome"), pick("transaction_hash", "transactionHash", "tx_hash", "txHash", "hash").alias("transaction_hash"),
        (F.col("token.id").cast("string") if "id" in inner else F.lit(None).cast("string")).alias("asset_id"),
    ).where(F.col("timestamp_utc").isNotNull())
    if tokens is not None:
        known = tokens.select("asset_id", F.col("outcome").alias("token_outcome")).dropDuplicates(["asset_id"])
        rows = rows.join(known, "asset_id", "left").withColumn("outcome", F.coalesce("outcome", "token_outcome"))
    return rows.select("timestamp_utc", "price", "size", "outcome", "transaction_hash")


def filter_fill_asset(fills: DataFrame, asset: str, start: str | None = None) -> DataFrame:
    held = fills.where((F.col("makerAssetId") == asset) | (F.col("takerAssetId") == asset))
    return held if start is None else held.where(F.col("timestamp").cast("bigint") >= F.unix_timestamp(F.lit(start).cast("timestamp")))


def filter_fill_assets(fills: DataFrame, assets: DataFrame) -> DataFrame:
    """Fills with an asset of the table on either side, once each."""
    wanted = assets.select(F.col("asset_id")).distinct()
    maker = fills.join(wanted, F.col("makerAssetId") == F.col("asset_id"), "left_semi")
    taker = fills.join(wanted, F.col("makerAssetId") == F.col("asset_id"), "left_anti").join(wanted, F.col("takerAssetId") == F.col("asset_id"), "left_semi")
    return maker.unionByName(taker)


def count_trades(fills: DataFrame, tokens: DataFrame, start: str | None = None) -> DataFrame:
    """Fills of each market's assets on either side since a start; a fill between two of them counts for both."""
    held = fills if start is None else fills.where(F.col("timestamp").cast("bigint") >= F.unix_timestamp(F.lit(start).cast("timestamp")))
    sides = held.select(F.explode(F.array_distinct(F.array("makerAssetId", "takerAssetId"))).alias("asset_id")).groupBy("asset_id").agg(F.count("*").alias("n"))
    counted = tokens.join(sides, "asset_id", "left").groupBy("condition_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_trades"))
    return counted


def extract_asset_ids(df: DataFrame, object_col: str, key_col: str) -> DataFrame:
    """key_col and assets: values of a JSON object under keys that hold asset, token or clob, flat, in order, each once."""
    held = F.map_filter(F.from_json(object_col, "map<string,string>"), lambda k, v: F.lower(k).rlike("asset|token|clob"))
    values = F.flatten(F.transform(F.map_values(held), lambda v: F.coalesce(F.when(v.startswith("["), F.from_json(v, "array<string>")), F.array(v))))
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.coalesce(v != "", F.lit(False)))
    return df.select(key_col, F.array_distinct(clean).alias("assets"))


def asset_fallback_anti(candidates: DataFrame, tried: DataFrame) -> DataFrame:
    """Candidate assets that weren't tried; 0 and blank are none."""
    good = candidates.where((F.trim("asset_id") != "") & (F.col("asset_id") != "0")).distinct()
    return good.join(tried.select("asset_id"), "asset_id", "left_anti")


def size_scale(trades: DataFrame, key: str = "market_id", written: bool = False) -> DataFrame:
    """One row a market: quantiles of positive sizes, shares of whole sizes and of prices in [0, 1.05], and the scale they speak for.

    Trades are read three times; written says that they come from a table, so that their three columns needn't be written first.
    """
    if not written:
        trades = cut(trades.select(key, "size", "price"), "sizes")
    size = F.when((F.col("size") > 0) & (F.abs("size") < float("inf")), F.col("size"))
    price = F.when(F.abs("price") < float("inf"), F.col("price"))
    stats = trades.groupBy(key).agg(
        F.min(size).alias("least"),
        F.avg((F.abs(size - F.round(size)) <= 1e-9).cast("double")).alias("whole_share"), F.avg(price.between(0, 1.05).cast("double")).alias("price_share"),
    )
    stats = stats.join(exact_quantiles(trades, [key], {"q50": (size, 0.5), "q99": (size, 0.99)}), key, "left")
    scale = F.when((F.col("q50") >= 1e15) | (F.col("q99") >= 1e17), 1e18).when((F.col("q50") >= 1e5) & (F.col("q99") >= 1e8) & (F.col("whole_share") >= 0.9) & (F.col("price_share") >= 0.9), 1e6).otherwise(1.0)
    return stats.withColumn("scale", scale)


def normalize_size(trades: DataFrame, key: str = "market_id", written: bool = False) -> DataFrame:
    """Sizes divided by their market's scale. Trades that don't come from a table are written first; they stay where they are, as scales go out to them."""
    held = trades if written else cut(trades, "typed-trades")
    return held.join(small_side(size_scale(held, key, written=True).select(key, "scale"), "scales"), key).withColumn("size", F.col("size") / F.col("scale")).drop("scale")


def size_plausibility(trades: DataFrame, key: str = "market_id") -> DataFrame:
    """One row a market: whether sizes look unscaled, or look odd after scaling."""
    scaled = size_scale(trades, key)
    after = lambda c: F.col(c) / F.col("scale")
    odd = (after("q99") > 1e7) | (after("q50") > 1e5) | (after("least") < 1e-9)
    return scaled.select(key, "scale", F.coalesce((F.col("scale") == 1) & (F.col("q99") >= 1e8), F.lit(False)).alias("unscaled"), F.coalesce(odd, F.lit(False)).alias("implausible"))
