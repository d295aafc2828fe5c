"""Tables that streams keep up to date, a folder for each micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LatestRows:
    """The latest row of each key. A micro-batch writes what it changes to its own folder, and again if it runs again.

    Every compact batches a folder holds all keys, so a reader takes the last such folder and those after it. Older ones
    can go at any time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], compact: int = 50) -> None:
        self.spark, self.path, self.keys, self.order, self.compact = spark, path, list(keys), list(order), compact
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{path}/batch=-1/whole=true")

    def _folders(self, before: int | None) -> DataFrame:
        kinds = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("whole", T.BooleanType())])
        rows = self.spark.read.schema(kinds).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def read(self, before: int | None = None) -> DataFrame:
        """The rows as they are now, or as they were before a batch."""
        rows = self._folders(before)
        start = F.coalesce(rows.where("whole").agg(F.max("batch")).scalar(), F.lit(-1))
        return self._latest(rows.where(F.col("batch") >= start).drop("batch", "whole"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*[F.col(f"`{f.name}`") for f in self.schema]), F.struct(*self.order)).alias("row"))
        return best.select("row.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        """What a batch changes; of several rows of a key the latest."""
        whole = batch % self.compact == self.compact - 1
        new = rows.select(*[F.col(f"`{f.name}`") for f in self.schema])
        out = self._latest(self.read(batch).unionByName(new) if whole else new)
        out.write.mode("overwrite").parquet(f"{self.path}/batch={batch}/whole={str(whole).lower()}")
