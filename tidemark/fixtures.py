"""The logical tables of the engine, made from the generic test tables; SQL has the same in DuckDB's dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("market_id"), F.col("ts").cast("timestamp").alias("timestamp_utc"), (F.col("value") / 500).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"), F.when(F.col("user_id") % 2 == 0, "Yes").otherwise("No").alias("outcome"),
        F.col("event_id").alias("seq"), F.hex("event_id").alias("transaction_hash"),
    )


def tied_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily trades with many equal times and some empty days."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("market_id"), F.col("l_shipdate").cast("timestamp").alias("timestamp_utc"), F.col("l_discount").alias("price"), F.col("l_quantity").alias("size"),
        F.col("l_linestatus").alias("outcome"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"), F.hex("l_orderkey").alias("transaction_hash"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset, odd = (F.col("l_suppkey") % 25).cast("string"), F.col("l_linenumber") % 2 == 1
    shares = F.col("l_quantity") * 4e6
    quote = shares * F.col("l_discount") * 10
    amount = lambda c: F.round(c).cast("bigint").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("string").alias("timestamp"),
        F.hex("l_orderkey").alias("transactionHash"), F.when(odd, asset).otherwise("0").alias("makerAssetId"), F.when(odd, "0").otherwise(asset).alias("takerAssetId"),
        F.when(odd, amount(shares)).otherwise(amount(quote)).alias("makerAmountFilled"), F.when(odd, amount(quote)).otherwise(amount(shares)).alias("takerAmountFilled"),
    )


def token_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market a region; its tokens and outcomes are its nations, as JSON text."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = nations.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return listed.select(
        F.concat(F.lit("0x"), F.lpad(F.col("r_regionkey").cast("string"), 8, "0")).alias("condition_id"), F.lower("r_name").alias("slug"), (F.col("r_regionkey") % 2 == 0).alias("active"),
        F.to_json(F.transform("x", lambda v: v["n_nationkey"].cast("string"))).alias("clob_token_ids"), F.to_json(F.transform("x", lambda v: v["n_name"])).alias("outcomes"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("volume"), F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_extendedprice"))).alias("volume24hr"),
        F.sum(F.when(F.col("l_linenumber") <= 3, F.col("l_extendedprice"))).alias("volume1wk"), F.avg("l_discount").alias("spread"),
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("condition_id"), F.concat(F.lit("order-"), F.col("o_orderkey")).alias("slug"), F.col("o_orderpriority").alias("question"),
        (F.col("o_orderstatus") == "O").alias("active"), (F.col("o_orderstatus") == "F").alias("closed"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_totalprice").alias("liquidity"), F.round("volume", 4).alias("volume"), F.round("volume24hr", 4).alias("volume24hr"), F.round("volume1wk", 4).alias("volume1wk"), F.round("spread", 8).alias("spread"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    docs = table(spark, sf_dir, "documents")
    share = F.floor(F.col("doc_id") * 2_592_000 / docs.agg(F.count("*")).scalar())  # of thirty days, whatever the table's size
    docs = docs.withColumn("page", F.col("doc_id") % pages.agg(F.count("*")).scalar())
    seen = F.timestamp_seconds(F.lit(1704067200) + share)
    return docs.join(pages, F.col("page") == F.col("page_id")).select(
        F.col("doc_id").alias("seq"), F.date_format(seen, "yyyyMMddHHmmss").alias("seendate"), F.col("text").alias("title"), "url", "source", F.col("lang").alias("language"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book messages as JSON text: camelCase keys where event_id is odd, an array where it is a multiple of ten."""
    e = table(spark, sf_dir, "events")
    snake = F.to_json(F.struct("event_type", F.col("user_id").cast("string").alias("asset_id"), "value"))
    camel = F.to_json(F.struct(F.col("event_type").alias("eventType"), F.col("user_id").cast("string").alias("assetId"), "value"))
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("["), snake, F.lit("]"))).when(F.col("event_id") % 2 == 1, camel).otherwise(snake)
    return e.select(F.col("ts").cast("timestamp").alias("received_at"), F.col("event_id").alias("seq"), text.alias("message"))


#: The same tables for DuckDB, as common table expressions.
SQL = {
    "trades": """trades AS (SELECT event_type AS market_id, ts AS timestamp_utc, value / 500 AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size,
        CASE WHEN user_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS outcome, event_id AS seq, upper(to_hex(event_id)) AS transaction_hash FROM events)""",
    "tied_trades": """tied_trades AS (SELECT l_returnflag AS market_id, l_shipdate AS timestamp_utc, l_discount AS price, l_quantity AS size, l_linestatus AS outcome,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, upper(to_hex(l_orderkey)) AS transaction_hash FROM lineitem)""",
    "fills": """fills AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CAST(CAST(epoch(l_shipdate) AS BIGINT) AS VARCHAR) AS timestamp, upper(to_hex(l_orderkey)) AS transactionHash,
        CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey % 25 AS VARCHAR) ELSE '0' END AS makerAssetId, CASE WHEN l_linenumber % 2 = 1 THEN '0' ELSE CAST(l_suppkey % 25 AS VARCHAR) END AS takerAssetId,
        CAST(CAST(round(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity * 4e6 ELSE l_quantity * 4e6 * l_discount * 10 END) AS BIGINT) AS VARCHAR) AS makerAmountFilled,
        CAST(CAST(round(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity * 4e6 * l_discount * 10 ELSE l_quantity * 4e6 END) AS BIGINT) AS VARCHAR) AS takerAmountFilled FROM lineitem)""",
    "tokens": """tokens AS (SELECT '0x' || lpad(CAST(n_regionkey AS VARCHAR), 8, '0') AS condition_id, CAST(n_nationkey AS VARCHAR) AS asset_id, n_name AS outcome,
        row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation)""",
    "markets": """markets AS (SELECT CAST(o_orderkey AS VARCHAR) AS condition_id, 'order-' || o_orderkey AS slug, o_orderpriority AS question, o_orderstatus = 'O' AS active, o_orderstatus = 'F' AS closed,
        o_orderdate AS created_at, o_totalprice AS liquidity, round(volume, 4) AS volume, round(volume24hr, 4) AS volume24hr, round(volume1wk, 4) AS volume1wk, round(spread, 8) AS spread
        FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS volume, sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS volume24hr,
        sum(CASE WHEN l_linenumber <= 3 THEN l_extendedprice END) AS volume1wk, avg(l_discount) AS spread FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""",
    "articles": """articles AS (SELECT doc_id AS seq, strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(doc_id * 2592000 // (SELECT count(*) FROM documents) AS BIGINT)), '%Y%m%d%H%M%S') AS seendate, text AS title, url, source, lang AS language
        FROM documents JOIN pages ON doc_id % (SELECT count(*) FROM pages) = page_id)""",
}
