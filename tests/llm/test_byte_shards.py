import random
import zlib

from tidemark.llm.byte_shards import byte_shards, write_shards

from . import brute


def check(spark, rows, shards):
    got = brute.rows(byte_shards(brute.documents(spark, rows), shards))
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, size[i], zlib.crc32((t or "").encode())) for i, t in rows}
    assert len(got) == len(rows)
    done, total = 0, sum(len((t or "").encode()) + 1 for _, t in rows)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["text_crc32"])):
        assert r["shard"] == (2 * done + r["size"]) * shards // (2 * total)
        done += r["size"]
    for k in range(shards):
        mine = sorted((r for r in got if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert [r["doc_id"] for r in mine] == sorted(r["doc_id"] for r in mine)
        assert abs(sum(r["size"] for r in mine) - total / shards) <= max(r["size"] for r in got)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(k * 7 - 50, rng.choice([None, "", "é" * rng.randrange(200), "same"])) for k in range(300)]
    check(spark, rows, 8)
    check(spark, rows, 3)
    check(spark, rows[:3], 8)
    check(spark, [(5, "x" * 10000), *[(k, "y") for k in range(40) if k != 5]], 4)


def test_repeated_and_null_ids_and_empty_table(spark):
    got = brute.rows(byte_shards(brute.documents(spark, [(1, "a"), (1, "a"), (1, "bb"), (None, "c")]), 2))
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert next(r for r in got if r["doc_id"] is None)["shard"] == 0
    assert byte_shards(brute.documents(spark, []), 8).count() == 0


def test_files(spark, tmp_path):
    docs = brute.documents(spark, [(k, "x" * k) for k in range(50)])
    write_shards(docs, str(tmp_path / "out"), 4)
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == [f"shard={k}" for k in range(4)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_files_hold_every_row_and_column(spark, tmp_path):
    rows = [(None, "a", 1, "p"), (None, "a", 1, "p"), (3, None, 2, "q"), (3, "b", None, None), (3, "b", 4, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string")
    write_shards(docs, str(tmp_path / "out"), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("document.*").collect()), key=str) == sorted(rows, key=str)
    assert sorted((r["shard"], r["slot"]) for r in back.collect()) == sorted((r["shard"], r["slot"]) for r in byte_shards(docs, 2).collect())
    write_shards(docs.limit(0), str(tmp_path / "none"), 2)
