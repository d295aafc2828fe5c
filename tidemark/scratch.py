"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A fresh folder in the cluster's shared checkpoint folder; in a temporary one only where none is set, as in tests."""
    app = spark.sparkContext.applicationId
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _own[app] = root
    return f"{root.rstrip('/')}/{app}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, reader: SparkSession | None = None) -> DataFrame:
    """df written to a fresh folder and read back, for tables that several plans read; reader: the session that reads it, if not df's own."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)
