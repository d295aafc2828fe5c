import random

import pyarrow as pa

from tidemark.llm import words as W
from tidemark.llm.repetition_rules import longest_repeats, repetition_rules

from . import brute


def cases():
    rng = random.Random(11)
    vocabulary = ["a", "b", "é#", "d|*", "longer"] + [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(50):
        x = rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 50, 200]))
        for _ in range(rng.choice([0, 1, 3])):
            at = rng.randrange(len(x) + 1)
            x[at:at] = x[rng.randrange(len(x) + 1) :][: rng.choice([3, 8, 12])]
        texts.append("".join(y + rng.choice([" ", " ", "\n", "\t", "\n\n"]) for y in x))
    texts += ["a " * 40, "a b " * 40, "", None, " \n \n", "same line here\n" * 9, "[#*$%&|<>]", "x" * 5000, "one\r\none\r\none"]
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    got = repetition_rules(brute.documents(spark, cases())).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect())) == brute.op2(cases())


def test_longest_repeats():
    texts = [t or "" for _, t in cases()]
    for least in (1, 3, 6, 8):
        for row, data, bounds in W.slices(pa.array(texts), 700):
            words = W.split_words(data, bounds)
            longest = longest_repeats(words, least)
            for i in range(words.texts):
                w = brute.BLANK_WORD.findall(texts[row + i])
                assert longest[words.first[i] : words.first[i + 1]].tolist() == brute.longest_repeats(w, least)


def test_verdict(spark):
    rng = random.Random(2)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    passage = " ".join(f"v{k}" for k in range(90))
    rows = [(1, clean), (2, clean + " " + passage + " x " + passage), (3, (" ".join(clean.split()[:40]) + " ") * 3), (4, "few words")]
    got = {r["doc_id"]: (r["kept"], r["longest_repeat"]) for r in repetition_rules(brute.documents(spark, rows)).collect()}
    assert got == {1: (True, 0), 2: (False, 90), 3: (False, 80), 4: (False, 0)}


def test_empty_table(spark):
    assert repetition_rules(brute.documents(spark, [])).count() == 0
