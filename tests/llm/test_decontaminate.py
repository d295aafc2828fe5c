import random

import numpy as np

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.fm_index import FmIndex

from . import brute


def cases():
    rng = random.Random(4)
    vocabulary = ["The", "of", "É", "x1", "don't", "end."] + [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 30])))) for k in range(25)]
    items += [(90, ""), (91, None), (92, "?!"), (93, items[3][1]), (94, "of of of of of of of of of of of")]
    texts = []
    for k in range(80):
        x = rng.choices(vocabulary + [f"z{j}" for j in range(40)], k=rng.choice([0, 4, 60, 200]))
        if k % 2:
            y = (rng.choice(items)[1] or "").upper().split()
            x[len(x) // 2 : len(x) // 2] = y[: rng.choice([5, 10, 40])]
        texts.append("\n".join(x))
    texts += ["", None, "of " * 30, texts[1], "The THE the, of-of"]
    return list(enumerate(texts)), items


def tables(spark, items):
    return spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, spans long")


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_equals_brute_force(spark):
    rows, items = cases()
    items = [x for x in items if len(brute.alnum(x[1])) != 1]
    got = decontaminate(brute.documents(spark, rows), tables(spark, items)).select(COLUMNS)
    assert sorted(map(tuple, got.collect())) == brute.op3(rows, items)
    assert 0 < sum(x[5] for x in brute.op3(rows, items)) < len(rows)


def test_blocks_and_one_word_items(spark):
    rows, items = cases()
    items.append((95, "z5"))
    got = decontaminate(brute.documents(spark, rows), tables(spark, items), most_block_bytes=2000).select(COLUMNS)
    assert sorted(map(tuple, got.collect())) == brute.op3(rows, items)


def test_text_and_empty_tables(spark):
    item = "a b c d e f g h i j"
    docs = brute.documents(spark, [(1, "keep (A b c d e f g h i J) this"), (2, "nothing"), (3, None)])
    got = {r["doc_id"]: r["clean_text"] for r in decontaminate(docs, tables(spark, [(1, item)]), with_text=True).collect()}
    assert got == {1: "keep () this", 2: "nothing", 3: None}
    assert decontaminate(docs, tables(spark, [])).where("contaminated").count() == 0
    assert decontaminate(brute.documents(spark, []), tables(spark, [(1, item)])).count() == 0


def test_index_against_scan():
    rng = np.random.default_rng(8)
    for sigma in (1, 2, 9):
        s = rng.integers(0, sigma + 1, 400)
        s[-1] = 0
        index = FmIndex(s, 8)
        for m in (1, 2, 5):
            patterns = rng.integers(1, sigma + 3, (40, m))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high, strict=True):
                want = [k for k in range(len(s) - m + 1) if (s[k : k + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_blocks_are_bounded_whatever_repeats(spark):
    from tidemark.llm.decontaminate import _blocks

    rows = [(1, "w" * 300)] * 200 + [(k, f"item {k} " * 20) for k in range(60)] + [(99, "x" * 5000), (None, "y"), (5, None)]
    blocks = list(_blocks(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text", 2000))
    size = lambda b: sum(len(i) + len(t) + 64 for i, t in b)
    assert all(size(b) <= 2000 or len(b) == 1 for b in blocks) and len(blocks) > 3
    assert sorted(x for b in blocks for x in b) == sorted({("" if i is None else str(i), t) for i, t in rows if t is not None})


def test_a_long_item_in_pieces_and_repeated_items(spark):
    rng = random.Random(6)
    long = [f"v{rng.randrange(400)}" for _ in range(1500)]
    items = [(1, " ".join(long)), (2, "short one"), *[(k, "same words here") for k in range(10, 60)], (3, "é" * 3000 + " " + " ".join(long[:12]))]
    rows = [(k, " ".join([*long[a : a + n], "same words here short", "one"])) for k, (a, n) in enumerate((rng.randrange(1400), rng.choice([5, 9, 10, 11, 40])) for _ in range(120))]
    rows += [(500, " ".join(long)), (501, "same words here " * 200)]
    for size in (600, 3000, 1 << 22):
        got = decontaminate(brute.documents(spark, rows), tables(spark, items), most_block_bytes=size).select(COLUMNS)
        assert sorted(map(tuple, got.collect())) == brute.op3(rows, items)


def test_parts_of_a_batch(spark, monkeypatch):
    from tidemark.llm import decontaminate as D

    rows, items = cases()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows], pa.string())], names=["i", "t"])
    monkeypatch.setattr(D, "PART_BYTES", 300)
    parts = list(D._parts(batch))
    assert len(parts) > 9 and [x for p in parts for x in p.column(1).to_pylist()] == [t for _, t in rows]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [i for i, _ in rows]
