"""Readers and writers of the engine's tables, and rows out of nested payloads."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.series import total_before
from ..scratch import cut

FILL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "timestamp", "transactionHash", "makerAssetId", "takerAssetId", "makerAmountFilled", "takerAmountFilled")])
ENVELOPES = ("data", "markets", "results", "items")


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file, or a folder with its partition folders."""
    return spark.read.parquet(path)


def sink_parquet(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> str:
    (df.write.mode("overwrite").partitionBy(*partition_cols) if partition_cols else df.write.mode("overwrite")).parquet(path)
    return path


def sink_json_summary(summary: DataFrame, path: str) -> str:
    """A table of one row as a JSON object."""
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def scan_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines with a declared schema, or one found from all rows; missing keys are null.

    Without a schema every line is parsed once, to a variant, and the variants are written; they give the schema, and then
    the columns. Columns go in order of their names; numbers with a fraction are doubles, keys with values of unlike kinds
    and those that are always null are text. Blank lines are no rows; a line that can't be parsed is a row of nulls.
    """
    if schema:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    held = cut(lines.select(F.try_parse_json("value").alias("v")), "json-lines")
    found = held.agg(F.schema_of_variant_agg("v")).first()[0]
    if not found.startswith("OBJECT<"):
        return spark.read.json(path)  # lists at the top, or no objects at all
    kind = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", re.sub(r"\b(VOID|VARIANT)\b", "STRING", found.replace("OBJECT<", "STRUCT<")))
    return held.select(F.col("v").try_cast(kind).alias("r")).select("r.*")


def scan_fills(spark: SparkSession, path: str) -> DataFrame:
    """Raw fills, all fields as text: token ids are longer than any number type."""
    return spark.read.schema(FILL_SCHEMA).json(path)


def flatten_envelope(df: DataFrame, payload_col: str, envelopes: Sequence[str] = ENVELOPES, wrap: bool = False) -> DataFrame:
    """A row per item of a JSON payload that is a list, or an object that holds one under an envelope key; the first key with a list wins.

    Adds pos and item (JSON text of an object). Items that are no objects go, or are wrapped as {"value": x}.
    """
    payload = F.col(payload_col)
    held = [F.when(F.trim(payload).startswith("["), payload)] + [F.when(F.get_json_object(payload, f"$.{k}").startswith("["), F.get_json_object(payload, f"$.{k}")) for k in envelopes]
    listed = F.from_json(F.coalesce(*held), "array<string>")
    rows = df.select(*[c for c in df.columns if c != payload_col], F.posexplode(listed).alias("pos", "item"))
    is_object = F.trim("item").startswith("{")
    return rows.withColumn("item", F.when(is_object, F.col("item")).otherwise(F.to_json(F.struct(F.col("item").alias("value"))))) if wrap else rows.where(is_object)


def flatten_article_pages(pages: DataFrame, page_col: str, articles_col: str, most: int | None = None) -> DataFrame:
    """Articles of pages (arrays of structs) with their page and pos: the first most of them in that order.

    The cap comes from running totals of the pages' sizes, so articles are not sorted.
    """
    held = pages if most is None else _capped(pages, page_col, articles_col, most)
    rows = held.select(page_col, *([] if most is None else ["__room"]), F.posexplode(articles_col).alias("pos", "article"))
    return (rows if most is None else rows.where("pos < __room")).select(page_col, "pos", "article.*")


def count_article_pages(pages: DataFrame, page_col: str, articles_col: str, most: int | None = None) -> DataFrame:
    """One row: article_count, of the articles within the cap, and page_count, of the pages that are read until it is reached."""
    n = F.coalesce(F.size(articles_col), F.lit(0))
    if most is None:
        return pages.agg(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("article_count"), F.count("*").alias("page_count"))
    held = _capped(pages, page_col, articles_col, most)
    return held.agg(F.coalesce(F.sum(F.least(n.cast("bigint"), "__room")), F.lit(0)).alias("article_count"), F.count("*").alias("page_count"))


def _capped(pages: DataFrame, page_col: str, articles_col: str, most: int) -> DataFrame:
    """Pages before which fewer than most articles lie, with __room: how many more there may be."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = total_before(pages, F.coalesce(F.size(articles_col), F.lit(0)), "__articles", [], [page_col], n)
    return sized.where(F.col("__articles") < most).withColumn("__room", F.lit(most).cast("bigint") - F.col("__articles")).drop("__articles")
