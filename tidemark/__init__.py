"""Market-event analytics on Spark: trades, bars, structural breaks, market rankings, news and order-book streams."""
