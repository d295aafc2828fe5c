"""A training corpus from raw documents, in stages; each stage is one operator of tidemark.llm.

An application, so it sets its session where the operators don't: documents can be long, and each stage lets few rows go
to a Python worker at once. run() puts the setting back; whoever runs a stage by itself writes its rows under it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontaminate import remove_benchmark
from tidemark.llm.disclosure import clean_documents
from tidemark.llm.near_duplicates import drop_near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.repetition_rules import keep_by_rules
from tidemark.llm.shared import cut, small_batches


def _few_rows(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep. Null and empty texts go; equal rows stay or go together."""
    _few_rows(spark)
    return keep_by_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more, that of the smallest id.

    Of equal rows one stays; rows of one id with unlike texts are judged each by its own; null ids and texts stay.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Every row stays, null and empty texts as they are."""
    _few_rows(spark)
    return remove_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and terms that disclose it replaced. Every row stays, null and empty texts as they are."""
    return clean_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces and their places in sequences of 2048 tokens; a null or empty text is one piece, the end id. Every row is packed.

    All stages give an empty table for an empty one, and take further columns of any name.
    """
    _few_rows(spark)
    return pack(docs, 2048, with_ids=False)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("privacy", privacy), ("packing", packing)]

#: SQL can express neither the tokenizer nor the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next. The session's settings come back after them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), name)
    return docs
