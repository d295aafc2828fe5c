"""The registered queries of this subpackage: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .byte_shards import byte_shards
from .collocations import collocations
from .decontaminate import decontaminate
from .disclosure import sanitise
from .license_templates import license_scan
from .merkle import FIELDS, fold, leaf_digest, merkle_manifest, proof_digest
from .near_duplicates import near_duplicates
from .packing import pack
from .records import read_token_records, write_token_records
from .repetition_rules import repetition_rules
from .shared import new_dir
from .substring_dedup import remove_repeated_windows
from .url_filter import Rule, filter_urls, url_host
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_revisit_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = write_archives(_table(spark, sf_dir, "pages"), new_dir(spark, "archives"))
    return read_archives(spark, listing, with_payload=False).drop("url")


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(_table(spark, sf_dir, "documents"), 8)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("matches")


def op4_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), 2048, with_ids=False)


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(_table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = write_token_records(_table(spark, sf_dir, "documents"), new_dir(spark, "token-records"))
    return read_token_records(spark, listing, with_ids=False)


def op7_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2).drop("text_hash")


def op11_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    listed = pages.where(url_host(F.col("url")).rlike(f"(^|\\.)({'|'.join(oracles.UNWANTED)})\\."))
    return filter_urls(pages, listed, [Rule(*r) for r in oracles.URL_RULES])


def op12_slot_pivot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    copy = [F.col(c) if c != "text" else F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") for c in FIELDS]
    proofs = merkle_manifest(_table(spark, sf_dir, "documents"), carry={"claimed": F.when(tampered, leaf_digest(copy))}).proofs
    folded = fold(F.col("path"), F.coalesce("claimed", "leaf"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_count_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_repetition_rules, op3_decontamination, op4_swap_packing, op5_disclosure, op6_token_records, op7_minmax_hashing, op8_revisit_archives, op9_byte_shards, op10_license_templates, op11_blocked_bloom_urls, op12_slot_pivot_manifest, op13_count_automata)}
ORACLES = {"op1_substring_dedup": oracles.OP1, "op2_repetition_rules": oracles.OP2, "op3_decontamination": oracles.OP3, "op7_minmax_hashing": oracles.OP7, "op8_revisit_archives": oracles.OP8, "op11_blocked_bloom_urls": oracles.OP11, "op12_slot_pivot_manifest": oracles.OP12, "op13_count_automata": oracles.OP13}
