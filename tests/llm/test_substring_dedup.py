import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import recompression as R
from tidemark.llm import words as W
from tidemark.llm.substring_dedup import named_windows, remove_repeated_windows

from .brute import documents, op1


def result(df):
    return sorted((r[0], r[1], r[2], r[3]) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect())


def cases():
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "dd", "é", "x" * 40] + [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 12, 13, 14, 40, 120]))) for _ in range(60)]
    for k in range(20):
        x, y = texts[rng.randrange(60)].split(), texts[rng.randrange(60)].split()
        cut = rng.randrange(len(x) + 1)
        texts.append("\n".join(y[:10]) + " " + "\t".join(x[cut:]) + " " + " ".join(y[10:]))
    texts += ["a " * 30, "a " * 17 + "b", "b " + "a " * 14, "a b " * 20, "b a " * 9, "", None, " \n ", texts[5], texts[5]]
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    rows = cases()
    random.Random(1).shuffle(rows)
    assert result(remove_repeated_windows(documents(spark, rows))) == op1(rows)


def test_other_windows_and_repeated_ids(spark):
    rows = cases()
    rows = [(i // 2, t) for i, t in rows]
    for window in (2, 5):
        assert result(remove_repeated_windows(documents(spark, rows), window=window)) == op1(rows, window)


def test_empty_table(spark):
    assert remove_repeated_windows(documents(spark, [])).count() == 0


def test_spans_and_null_id(spark):
    text = " ".join(f"w{k}" for k in range(15))
    got = {r["doc_id"]: r for r in remove_repeated_windows(documents(spark, [(None, "x " + text), (4, text)])).collect()}
    assert got[4]["n_removed"] == 0 and got[None]["removed"] == [[1, 16]] and got[None]["kept_text"] == "x"


def test_equal_windows_have_equal_names():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 2, 200))) for _ in range(20)]
    for row, data, bounds in W.slices(pa.array(texts)):
        words = W.split_words(data, bounds)
        at, core, name = named_windows(words, 13)
        seen = {}
        token = [bytes(data[s:e]) for s, e in zip(words.starts, words.ends, strict=True)]
        for a, c, n in zip(at, core, name, strict=True):
            assert seen.setdefault(tuple(token[a : a + 13]), (c, n)) == (c, n)
        assert len({n for _, n in seen.values()}) == len(seen)


def test_many_small_chunks(spark):
    rng = random.Random(9)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(400)]
    rows = cases()
    for k in range(40):
        a, b = sorted(rng.choices(range(400), k=2))
        rows.append((100 + k, " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))), *passage[a:b], "end", *passage[: rng.randrange(20)]])))
    rows += [(200, " ".join(passage)), (201, " ".join(passage * 3)), (150, None)] + [(300, " ".join(passage))] * 5
    for size in (200, 3000):
        assert result(remove_repeated_windows(documents(spark, rows).repartition(6), chunk_bytes=size)) == op1(rows)


def test_inner_symbols_decide():
    """Windows that differ only inside are told apart by the symbols of higher levels alone."""
    rng = np.random.default_rng(1)
    texts = [" ".join(["a", "b", "c", "d", *map(str, rng.integers(0, 50, 5)), "e", "f", "g", "h"]) for _ in range(300)]
    ((_, data, bounds),) = W.slices(pa.array(texts))
    words = W.split_words(data, bounds)
    h, at = words.hashes(), words.windows(13)
    levels = R.levels_of(h, words.text_of(), 4)
    assert len(set(R.sequence_names(h, levels, at, 13)[1].tolist())) == len(set(texts))
    for level in levels:
        level.names[:] = 7
    assert len(set(R.sequence_names(h, levels, at, 13)[1].tolist())) < len(set(texts)) // 2


def test_equal_stretches_have_equal_symbols_inside():
    rng = np.random.default_rng(2)
    stretch = rng.integers(0, 1000, 600).tolist()
    texts = [" ".join(map(str, [*rng.integers(0, 1000, n).tolist(), *stretch, *rng.integers(0, 1000, n).tolist()])) for n in (5, 50, 333)]
    ((_, data, bounds),) = W.slices(pa.array(texts))
    words = W.split_words(data, bounds)
    levels = R.levels_of(words.hashes(), words.text_of(), 12)
    assert all(set.intersection(*[set(level.names[level.text == t].tolist()) for t in range(3)]) for level in levels)
    assert len(levels[-1].names) < len(words.starts) / 20
