"""Very long texts and rows that repeat, through every operator on texts."""

import random

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.disclosure import sanitise
from tidemark.llm.license_templates import license_scan
from tidemark.llm.near_duplicates import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.records import read_token_records, write_token_records
from tidemark.llm.repetition_rules import repetition_rules
from tidemark.llm.substring_dedup import remove_repeated_windows

from . import brute

rng = random.Random(3)
WORDS = " ".join(f"w{rng.randrange(10**7)}" for _ in range(60_000))
TEXTS = [WORDS, "x" * 700_000, "1" * 300_000, "1 " * 100_000, "a@" * 100_000, "é\n" * 100_000, "same words " * 30_000, WORDS + " more", "+1 2" * 50_000]


def test_long_texts(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (3, TEXTS[3])]
    docs = brute.documents(spark, rows)
    bench = spark.createDataFrame([(1, " ".join(WORDS.split()[30_000:30_020]))], "item_id long, text string")

    dedup = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeated_windows(docs).collect()}
    assert dedup[0] == (60_000, 0) and dedup[7] == (60_001, 60_000) and dedup[1] == (1, 0) and dedup[3] == (100_000, 0)
    rules = {r["doc_id"]: (r["longest_repeat"], r["kept"]) for r in repetition_rules(docs).collect()}
    assert rules[0] == (0, True) and rules[3] == (99_999, False) and rules[6] == (59_998, False)
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate(docs, bench).collect()}
    assert hits[0] == 20 and hits[7] == 20 and sum(hits.values()) == 40
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle=2).collect()}
    assert near == {k: 0 if k == 7 else k for k in range(len(TEXTS))}
    assert license_scan(docs).where("n_base > 0").count() == 0
    found = {r["doc_id"]: r for r in sanitise(docs).collect()}
    assert found[1]["spans"] == "" and found[2]["n_card"] == 0 and found[4]["n_email"] == 0
    assert pack(docs, with_ids=False).agg({"length": "sum"}).first()[0] > 10**6
    assert read_token_records(spark, write_token_records(docs, f"file://{tmp_path}/r"), with_ids=False).count() == len(rows)
