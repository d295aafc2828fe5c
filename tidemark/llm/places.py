"""Every row's place in a global order, or in the order of its group, by totals of range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions


def with_places(df: DataFrame, order: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """Adds place (from 0) in the order of those columns and, with a weight column, before (its sum over earlier rows) and total.

    Rows are range-partitioned by the order, so that equal leading values can go to several partitions; a partition's
    running counts start from the totals of those before it, of which there is one row a partition.
    """
    n = partitions(df.sparkSession)
    value = F.col(weight) if weight else F.lit(1)
    ranged = cut(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumns({"upto": F.sum(value).over(inside), "rows": F.count("*").over(inside)})
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum(value).alias("part_sum"), F.count("*").alias("part_rows"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part", F.coalesce(F.sum("part_sum").over(earlier), F.lit(0)).alias("sum_before"), F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("part_sum").over(every).alias("total"),
    )
    placed = running.join(F.broadcast(totals), "part").withColumn("place", F.col("rows_before") + F.col("rows") - 1)
    if weight:
        return placed.withColumn("before", F.col("sum_before") + F.col("upto") - F.col(weight)).drop("part", "upto", "rows", "sum_before", "rows_before")
    return placed.drop("part", "upto", "rows", "sum_before", "rows_before", "total")


def with_group_places(df: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """Adds place (from 0) within the group in the order of those columns. group: a column without nulls.

    Rows are range-partitioned by group and order, so that a group of any size is split; rows of a partition's first group
    count on from the partitions before, of which there is one row a partition at most.
    """
    ranged = cut(df.repartitionByRange(partitions(df.sparkSession), group, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part", group).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("before", earlier).where("before > 0").drop("n")
    numbered = ranged.withColumn("row", F.row_number().over(Window.partitionBy("part", group).orderBy(*order))).join(F.broadcast(before), ["part", group], "left")
    return numbered.withColumn("place", (F.coalesce("before", F.lit(0)) + F.col("row") - 1).cast("long")).drop("part", "row", "before")
