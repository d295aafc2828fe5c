"""Columns of the input that have the names of inner columns, through every operator and stage."""

import random

import pytest

from tidemark.llm.byte_shards import byte_shards
from tidemark.llm.decontaminate import decontaminate, remove_benchmark
from tidemark.llm.disclosure import clean_documents, sanitise
from tidemark.llm.license_templates import license_scan
from tidemark.llm.near_duplicates import drop_near_duplicates, near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.records import read_token_records, write_token_records
from tidemark.llm.repetition_rules import keep_by_rules, repetition_rules
from tidemark.llm.substring_dedup import remove_repeated_windows
from tidemark.llm.warc import read_archives, write_archives

NAMES = (
    "id chunk bucket names docs times kind flags places gone gone_h gone_hash twice twice_h row h held given found every spans blocks base term terms entity entities no at before long "
    "start end put done shape shard slot place part total size crc weight key label node rep hub family low high own other text_hash bands f1 f2 n_shingles component_id kept n_words "
    "items n_hit clean_text ids length piece page_id digest refers_to file record __beside _ n"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(1, text), (2, text + " more"), (3, f"mail a@b.cc {text[::-1]}"), (3, f"mail a@b.cc {text[::-1]}"), (None, text), (5, None)]
    extra = [[rng.randrange(9) for _ in NAMES] for _ in rows]
    return spark.createDataFrame([(i, t, *x) for (i, t), x in zip(rows, extra, strict=True)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in NAMES))


def test_operators(spark, docs, tmp_path):
    bench = spark.createDataFrame([(1, "nothing of it", 2)], "item_id long, text string, item int")
    assert {f(docs).count() for f in (remove_repeated_windows, repetition_rules, near_duplicates, sanitise, byte_shards, license_scan)} == {6}
    assert decontaminate(docs, bench).count() == 6 and pack(docs).count() == 6
    assert read_token_records(spark, write_token_records(docs, f"file://{tmp_path}/r")).count() == 6
    pages = docs.withColumnsRenamed({"doc_id": "number", "text": "html"}).selectExpr("*", "html AS url")
    assert read_archives(spark, write_archives(pages, f"file://{tmp_path}/w", id_col="number")).count() == 6


def test_stages(spark, docs):
    bench = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    rows = sorted(map(tuple, docs.collect()), key=str)
    for f, n in ((keep_by_rules, 5), (lambda d: remove_benchmark(d, bench), 6), (clean_documents, 6), (drop_near_duplicates, 4)):
        out = f(docs)
        assert out.columns == docs.columns and out.count() == n
        if f is not clean_documents:
            assert set(map(tuple, out.collect())) <= set(rows)


def test_the_first_of_equal_rows_stays(docs):
    same = [tuple(r) for r in docs.where("doc_id = 3").collect()]
    stays = [tuple(r) for r in drop_near_duplicates(docs).where("doc_id = 3").collect()]
    assert len(stays) == 1 and stays[0] in same
    assert all([tuple(r) for r in drop_near_duplicates(docs.repartition(n)).where("doc_id = 3").collect()] == stays for n in (1, 5))
