import random

import corpus_pipeline
from tidemark.llm.decontaminate import remove_benchmark
from tidemark.llm.disclosure import clean_documents
from tidemark.llm.near_duplicates import drop_near_duplicates
from tidemark.llm.repetition_rules import keep_by_rules

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "privacy", "packing"]

    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == COLUMNS and kept.schema == docs.schema
    first = {r["doc_id"]: r["text"] for r in kept.collect()}
    failed = {r[0] for r in brute.op2(list(table.items())) if r[6]}
    assert not failed & set(first) and len(first) > 0.7 * len(table) and all(table[i] == t for i, t in first.items())

    once = corpus_pipeline.near_dedup(spark, kept, sf)
    assert once.columns == COLUMNS
    second = {r["doc_id"]: r["text"] for r in once.collect()}
    assert second == {r[0]: first[r[0]] for r in brute.op7(list(first.items()), 5) if r[3]}

    clear = corpus_pipeline.decontamination(spark, once, sf)
    third = {r["doc_id"]: r for r in clear.collect()}
    assert clear.columns == COLUMNS and set(third) == set(second)
    for i, n, hit, *_ in brute.op3(list(second.items()), items):
        assert len(brute.alnum(third[i]["text"])) == n - hit and third[i]["n_chars"] == len(third[i]["text"])
        assert hit or third[i]["text"] == second[i]
    assert sum(r[5] for r in brute.op3(list(second.items()), items))

    private = corpus_pipeline.privacy(spark, clear, sf)
    fourth = {r["doc_id"]: r["text"] for r in private.collect()}
    assert private.columns == COLUMNS and set(fourth) == set(third)
    for i, *n, _ in brute.op5([(i, r["text"]) for i, r in third.items()]):
        assert any(n) or fourth[i] == third[i]["text"]
    assert sum("[EMAIL]" in t for t in fourth.values())

    packed = brute.rows(corpus_pipeline.packing(spark, private, sf))
    assert {r["doc_id"] for r in packed} == set(fourth)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_odd_rows_go_through(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(None, text), (None, text), (4, text + " me@here.example"), (4, text + " me@here.example"), (4, text[::-1]), (5, None), (6, ""), (7, text.replace("1", "é"))]
    docs = plain(spark, rows)
    assert keep_by_rules(docs).count() == 6
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in drop_near_duplicates(docs).collect()))) == sorted(map(str, rows[:3] + rows[4:]))
    bench = spark.createDataFrame([(1, " ".join(text.split()[10:25]))], "item_id long, text string")
    got = [(r["doc_id"], r["n_chars"]) for r in remove_benchmark(docs, bench).collect()]
    assert len(got) == len(rows) and (5, None) in got and sum(n == len(text) - len(" ".join(text.split()[10:25])) for _, n in got) == 2
    clean = [(r["doc_id"], r["text"]) for r in clean_documents(docs).collect()]
    assert len(clean) == len(rows) and (5, None) in clean and (6, "") in clean and sum("[EMAIL]" in (t or "") for _, t in clean) == 2
    empty = plain(spark, [])
    assert all(f(empty).count() == 0 for f in (keep_by_rules, drop_near_duplicates, clean_documents)) and remove_benchmark(empty, bench).count() == 0
