"""Contiguous shards of near equal bytes, by prefix sums over partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import with_places
from .shared import cut, partitions


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the documents, in order of their ids, into shards of near equal size.

    A document's size is its UTF-8 bytes plus 1. Ids are range-partitioned; running sums inside a partition plus the
    totals of the partitions before it give every document's place among all bytes. It goes to the shard that holds
    its middle byte, so a shard's size is off by at most one document.

    Returns one row per input row: the id column, size, text_crc32 (of the UTF-8 bytes, unsigned), shard (from 0) and
    slot (from 0 within the shard, in order of ids).

    A null text has size 1. Null ids come first; rows of equal ids go by checksum, then size. Fewer documents than
    shards leave shards empty. Other columns are neither read nor kept. An empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return _placed(base, shards).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _placed(base: DataFrame, shards: int) -> DataFrame:
    """base: id, text and more. The text goes once its size and checksum are known."""
    text = F.coalesce("text", F.lit(""))
    base = base.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "crc": F.crc32(text.cast("binary"))}).drop("text")
    placed = with_places(base, ("id", "crc", "size"), "size")
    placed = cut(placed.withColumn("shard", F.expr(f"cast((2 * before + size) * {int(shards)} div (2 * total) AS int)")), "placed")
    starts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("place") - F.col("first"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents to path as Parquet, a folder shard=0 and so on for each shard, in order of their slots.

    A row there has slot and document, a struct of all columns of docs, whatever their names. No row is lost, whether its
    id or text is null or its id repeats. Nothing is written for empty shards, nor for an empty table.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    rows = _placed(whole, shards)
    n = partitions(docs.sparkSession)
    rows.select("shard", "slot", "document").repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
