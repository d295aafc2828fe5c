import random

import numpy as np
import pyarrow as pa

from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.llm.near_duplicates import drop_near_duplicates, min_max_bands, near_duplicates, shingle_sets
from tidemark.llm.shared import cut

from . import brute


def cases():
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        x = [f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 6, 30, 90]))]
        for _ in range(rng.choice([1, 4, 9])):
            texts.append(" ".join(x))
            x = x.copy()
            for _ in range(rng.choice([0, 1, 2, 5])):
                x[rng.randrange(len(x))] = f"v{rng.randrange(500)}"
    chain = [f"c{k}" for k in range(60)]
    for k in range(10):
        texts.append(" ".join(chain[k * 3 : k * 3 + 30]))
    texts += ["", None, " \n", "One", "one", "one two", "ONE TWO", "one two one two"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    for size in (2, 5):
        got = sorted(map(tuple, near_duplicates(brute.documents(spark, cases()), shingle=size).drop("text_hash").collect()))
        assert got == brute.op7(cases(), size)


def test_group_without_a_common_centre(spark):
    """Few bands of one value put all into one group, so that links far from the smallest id need the later rounds."""
    rng = random.Random(1)
    common = [f"s{k}" for k in range(40)]
    rows = []
    for k in range(40):
        own = [f"o{k // 2}_{j}" for j in range(20)]
        rows.append((k, " ".join(common + own + ([f"x{rng.randrange(9**9)}"] if k % 2 else []))))
    got = near_duplicates(brute.documents(spark, rows), shingle=2, bands=8, rows=1, percent=90)
    assert sorted(map(tuple, got.drop("text_hash").collect())) == brute.op7(rows, 2, 90)


def test_family_of_several_blocks(spark, monkeypatch):
    """Small blocks, so that links must be found across tasks."""
    from tidemark.llm import near_duplicates as module

    monkeypatch.setattr(module, "BLOCK", 7)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(120):
        x = base.copy()
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            x[rng.randrange(60)] = f"e{rng.randrange(9)}"
        rows.append((k, " ".join(x)))
    got = near_duplicates(brute.documents(spark, rows), shingle=2)
    want = brute.op7(rows)
    assert sorted(map(tuple, got.drop("text_hash").collect())) == want and len({w[2] for w in want}) > 1


def test_cells_and_texts_are_shuffled(spark):
    """Cells and near copies take little room in files and much in memory, so they don't go through the driver."""
    from tidemark.llm import near_duplicates as module

    texts = spark.createDataFrame([(k, f"a b c d e f g h i {'jklm'[k // 3]}") for k in range(12)], "node long, text string")
    rest = spark.createDataFrame([(0, k, k // 3 * 3) for k in range(12)], "low long, node long, own long")
    pairs = cut(spark.createDataFrame([(0, 1), (0, 11)], "lo long, hi long"), "pairs")
    found, kept = module._across(rest, texts, 2, 80), module._confirm(pairs, cut(texts, "texts"), 2, 80)
    for df in (found, kept):
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, found.collect())) == [(0, 3), (0, 6), (0, 9), (3, 6), (3, 9), (6, 9)]
    assert sorted(map(tuple, kept.collect())) == [(0, 1), (0, 11)]


def test_ids_and_empty_table(spark):
    rows = [(None, "a b c"), (3, "a b c"), (5, "a b c"), (5, "a b c"), (7, None)]
    got = sorted(map(tuple, near_duplicates(brute.documents(spark, rows), shingle=2).drop("text_hash").collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (7, 0, 7, True)], key=str)
    assert near_duplicates(brute.documents(spark, [])).count() == 0


def test_agreement_follows_similarity():
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(200):
        x = [f"w{k}" for k in rng.integers(0, 10**9, 120)]
        y = x.copy()
        y[:12] = [f"v{k}" for k in rng.integers(0, 10**9, 12)]
        texts += [" ".join(x), " ".join(y)]
    (_, data, bounds), *_ = W.slices(pa.array(texts), 1 << 30)
    sets, at = shingle_sets(data, bounds, 1)
    keys = min_max_bands(sets, at, 100, 1)
    share = (keys[::2] == keys[1::2]).mean()
    assert abs(share - 108 / 132) < 0.02
    assert abs((keys[::2, :50] == keys[1::2, :50]).mean() - (keys[::2, 50:] == keys[1::2, 50:]).mean()) < 0.04


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(200, 300)], "lo long, hi long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{k: 0 for k in range(71)}, 200: 200, 300: 200}


def similar(a, b, size=5, percent=80):
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return bool(sets[0]) and 100 * len(sets[0] & sets[1]) >= percent * len(sets[0] | sets[1])


def test_texts_of_one_id_stay_apart(spark):
    rng = random.Random(12)
    x, y, z = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "xyz")
    rows = [(3, x), (5, x + " more"), (5, y), (9, y + " tail"), (11, z)]
    docs = brute.documents(spark, rows)
    got = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in brute.rows(near_duplicates(docs))}
    assert sorted(got.values()) == [3, 3, 5, 5, 11]
    assert sorted((r["doc_id"], r["text"]) for r in brute.rows(drop_near_duplicates(docs))) == sorted([(3, x), (5, y), (11, z)])


def test_repeated_ids_equal_brute_force(spark):
    rng = random.Random(13)
    bases = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(25)]
    rows = []
    for _ in range(160):
        text = rng.choice(bases)
        for _ in range(rng.randrange(3)):
            text += f" e{rng.randrange(40)}"
        rows.append((rng.randrange(30), text))
    rows += rows[:15]
    texts = sorted({(i, t) for i, t in rows})
    group = {r: k for k, r in enumerate(texts)}
    for a in range(len(texts)):
        for b in range(a):
            if similar(texts[a][1], texts[b][1]) and group[texts[a]] != group[texts[b]]:
                old, new = group[texts[a]], group[texts[b]]
                group = {r: new if g == old else g for r, g in group.items()}
    least = {g: min(i for (i, _), o in group.items() if o == g) for g in set(group.values())}
    docs = brute.documents(spark, rows)
    found = near_duplicates(docs).join(docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text").distinct(), ["doc_id", "text_hash"])
    assert sorted((r["doc_id"], r["text"], r["component_id"]) for r in brute.rows(found)) == sorted((i, t, least[group[(i, t)]]) for i, t in rows)
    stay = [(r["doc_id"], r["text"]) for r in brute.rows(drop_near_duplicates(docs))]
    assert len(stay) == len({group[r] for r in stay}) == len(least) and {group[r] for r in stay} == set(least)
