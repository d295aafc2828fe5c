"""Tables cut from their lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (spark.checkpoint.dir); a temporary one only where that is unset, as in tests."""
    app = spark.sparkContext.applicationId
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _own[app]
    return f"{root.rstrip('/')}/{app}"


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once in the jobs that write such tables, since texts can be long.
BATCH_ROWS = 2_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """For the jobs run inside; the session's setting comes back after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(name)
    if not 0 < int(given) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, given)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and returns it read back, so that a lost executor costs no recomputation above it."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows up to which a counted table goes out to all executors.
BROADCAST_ROWS = 100_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of table, which has one row for each of the keys that occur. By broadcast if table was counted
    to be small; else by a shuffle, in which keys of very many rows, a few for each partition at most, are broadcast.
    """
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(table), keys)
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")), "counts")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.where(F.col("__n") > max(1, total // (4 * partitions(rows.sparkSession)))).select(*keys)
    hot_rows = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys)
    return hot_rows.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))
