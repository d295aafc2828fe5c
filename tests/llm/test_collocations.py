import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations as C
from tidemark.llm import count_nets as N

from . import brute


def expected(rows, most=3, least=10, inside=50, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute.LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            f = counts.setdefault(lang, Counter())
            for m in range(1, most + 1):
                f.update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, r, totals[lang], -s) for k, (s, a, p, left, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], "text string, lang string, words int, n int, part int, phrase string, a int")


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in brute.rows(df))


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "x\x00y", "Z.", "two,", "\x0b", "\n", "\t", "ß", "q?r", "nbsp\xa0", "𝄞"] + [f"w{k}" for k in range(15)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.6 else "New york" for _ in range(rng.randrange(60))) for _ in range(n)]
    return [(t, rng.choice(["en", "en", "de", None, "", "und"])) for t in texts] + [(None, "en"), ("", None), ("  ", "fr"), ("hot pair " * 400, "de")] + [("same text of copies", "en")] * 30


@pytest.mark.parametrize("shard", [8 << 20, 600])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(C, "SHARD_BYTES", shard)
    monkeypatch.setattr(C, "MARK", 8)
    monkeypatch.setattr(C.W, "SLICE_BYTES", 500)
    rows = rows_of(shard, 150)
    docs = table(spark, rows).repartition(5)
    assert got(C.collocations(docs)) == expected(rows)


def test_other_parameters(spark):
    rows = rows_of(9, 60)
    docs = table(spark, rows)
    assert got(C.collocations(docs, most_words=2, least=3, inside_percent=100, top=7)) == expected(rows, 2, 3, 100, 7)
    assert got(C.collocations(docs, most_words=4, least=5, inside_percent=80, filter_bytes=64)) == expected(rows, 4, 5, 80)


def test_empty_and_without_candidates(spark):
    assert C.collocations(table(spark, [])).count() == 0
    assert C.collocations(table(spark, [(None, None), ("one two", "en")])).count() == 0


def test_long_text(spark):
    rows = [("a b " * 200_000, "en"), ("x" * 300_000 + " y", "en")]
    assert got(C.collocations(table(spark, rows))) == expected(rows)


def phrases(paths):
    return {tuple(r): w for d in range(len(paths.word)) for r, w in zip(paths.phrases(d, np.arange(len(paths.word[d]))).tolist(), paths.weight[d].tolist(), strict=True) if w}


def of(words, most=3):
    h = np.array(words, np.int64)
    named = np.unique(h)
    joined = np.r_[np.ones(len(h) - 1, bool), False]
    return N.of_words(h, joined, (named, pa.array([str(x).encode() for x in named], pa.large_binary())), most)


def counted(words, most=3):
    return Counter(tuple(words[k : k + m]) for m in range(1, most + 1) for k in range(len(words) - m + 1))


def test_nets_hold_their_phrases_and_unions_sum():
    rng = random.Random(4)
    texts = [[rng.choice([-5, 0, 3, 4, 9, 2**62]) for _ in range(rng.randrange(1, 200))] for _ in range(5)]
    every = N.union([of(t) for t in texts])
    want = sum((counted(t) for t in texts), Counter())
    assert phrases(every) == want
    (_, net), *rest = N.cut_nets(every, [])
    again = N.paths_of(N.read(net))
    assert not rest and phrases(again) == want
    assert again.text.to_pylist() == [str(w).encode() for w in again.word[0].tolist()]
    assert phrases(N.frequent(every, 20)) == {p: n for p, n in want.items() if n >= 20}
    for size in (1, 2, 3):
        asked = [p for p in want if len(p) == size] + [(77,) * size, (3,) * (size - 1) + (78,)]
        found, _ = N.compose(N.read(net), np.array(asked, np.int64))
        assert found.tolist() == [want.get(p, 0) for p in asked]


def test_states_with_equal_right_languages_are_one():
    paths = of([1, 2, 3, 0, 5, 2, 3])
    (_, net), *_ = N.cut_nets(paths, [])
    assert paths.size == 15 and sum(map(len, N.read(net).label)) == 13  # what follows 1 and 5 is the same, and what follows (1, 2) and (5, 2)
    assert phrases(N.paths_of(N.read(net))) == counted([1, 2, 3, 0, 5, 2, 3])


def test_cuts_at_any_phrases_share_all_phrases_out():
    rng = random.Random(6)
    words = [rng.randrange(-6, 6) for _ in range(400)]
    want = counted(words)
    for n in (1, 3, 40):
        splitters = sorted({tuple(rng.randrange(-7, 7) for _ in range(rng.randrange(1, 4))) for _ in range(n)})
        found = {}
        for r, net in N.cut_nets(of(words), splitters):
            paths = N.paths_of(N.read(net))
            mine = phrases(paths)
            before = {p for p in mine if r and p < splitters[r - 1]}  # the splitter's prefixes, with their counts
            assert before == {splitters[r - 1][:k] for k in range(1, len(splitters[r - 1])) if splitters[r - 1][:k] in want} if r else not before
            assert all(r == len(splitters) or p < splitters[r] for p in mine) and all(mine[p] == want[p] for p in mine)
            if r:
                own = N.bounds(paths, [splitters[r - 1]])[0]
                assert sum(int(o[0]) for o in own) == len(before)
            mine = {p: n for p, n in mine.items() if p not in before}
            assert not set(mine) & set(found)
            found |= mine
        assert found == want


def test_filter_knows_frequent_keys():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    total = np.zeros(8 * 65536, np.int64)
    for n in (3, 7):
        at, counts = np.unique(N.slots(np.repeat(keys[:1000], n), len(total)), return_counts=True)
        N.add_counts(N.pack_counts(at, counts), total)
    made = N.Filter(np.packbits(total >= 10).tobytes())
    assert made.has(keys[:1000]).all() and made.has(keys[1000:]).mean() < 0.01


def test_marks_of_small_trees_lie_anywhere():
    rng = random.Random(2)
    trees = [of(rng.sample(range(10_000), 30)) for _ in range(300)]
    first = sorted(m[0] for t in trees for m in N.marks(t, 10_000))
    assert len(first) == 300 and all(abs(first[k * 60] - k * 2000) < 700 for k in range(1, 5))
    big = of([rng.randrange(2000) for _ in range(3000)])
    some = [tuple(m) for m in N.marks(big, 500)]
    assert len(some) == big.size // 500 and some == sorted(some) and len(set(some)) == len(some) and all(len(m) == 3 for m in some)
