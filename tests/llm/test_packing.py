import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import words as W
from tidemark.llm.packing import Plan, SwapSearch, fill, pack, swap_search
from tidemark.llm.tokens import Encoder

from . import brute


def texts():
    rng = random.Random(5)
    marks = ["Word", "the", "don't", "it's", "naïve", "É", "3.14", " ", "x y", "a　 b", "日本語", "é", "ΑΣ", "İ", "<|endoftext|>", "\x00", "a\x00b", "\x1c", "🙂👍🏽", "—", "'s", "#!", "x" * 300, "​"]
    blanks = [" ", " ", " ", "  ", "\n", "\t\n ", "\r\n", "\x0b"]
    out = ["".join(rng.choice(marks) + rng.choice(blanks) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(150)]
    out += ["".join(rng.choice(blanks) + rng.choice(marks) for _ in range(20)) for _ in range(50)]
    return [*out, "", " ", "\n\n", "no blanks", "   x", " ", "word  "]


def test_ids_equal_the_library():
    import pyarrow as pa

    for name, keep in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        plain.encode_special_tokens = True
        ours = Encoder(public_tokenizers.path(name), keep)
        for most in (1 << 20, 100):
            for row, data, bounds in W.slices(pa.array(texts()), most):
                ids, at = ours.ids(data, bounds)
                for k in range(len(bounds) - 1):
                    t = texts()[row + k]
                    assert ids[at[k] : at[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, (name, t)


def total(bins):
    out = Counter()
    for held, n in bins.items():
        for length, times in held:
            out[length] += times * n
    return out


def alone(counts):
    return Counter({((length, 1),): n for length, n in counts.items()})


def by_one_length(counts, capacity):
    out = Counter()
    for length, n in counts.items():
        each = capacity // length
        out[((length, each),)] += n // each
        if n % each:
            out[((length, n % each),)] += 1
    return +out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_plans_hold_every_piece(counts):
    for first in (alone(counts), by_one_length(counts, 40)):
        after = swap_search(first, 40)
        for bins in (first, after):
            assert total(bins) == Counter(counts)
            assert all(0 < fill(held) <= 40 for held in bins)
        assert after.total() <= first.total()


def better_exchange(bins, capacity):
    """Any exchange of three pieces or fewer that moves more to a bin at least as full, by brute force over single bins."""
    each = [[x for x, n in held for _ in range(n)] for held, times in bins.items() for _ in range(times)]
    some = lambda b: [(), *((x,) for x in set(b)), *{tuple(sorted(p)) for p in combinations(b, 2)}]
    for i, a in enumerate(each):
        for j, b in enumerate(each):
            if i != j and sum(a) >= sum(b) and sum(a) < capacity:
                for g in some(a):
                    for t in some(b):
                        if len(g) + len(t) <= 3 and 0 < sum(t) - sum(g) <= capacity - sum(a):
                            return a, b, g, t
    return None


def fewest_bins(pieces, capacity):
    """Exact, by branch and bound."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(pieces):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + pieces[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + pieces[k], *bins[i + 1 :]])
        place(k + 1, [*bins, pieces[k]])

    place(0, [])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_cases_against_the_optimum(pieces):
    bins = swap_search(alone(Counter(pieces)), 20)
    least = -(-sum(pieces) // 20)
    assert fewest_bins(pieces, 20) <= bins.total() <= fewest_bins(pieces, 20) + 1
    assert bins.total() == least or better_exchange(bins, 20) is None


def test_a_local_optimum_without_a_cap():
    rng = random.Random(1)
    counts = Counter(rng.randrange(500, 1100) for _ in range(1500))
    search = SwapSearch(alone(counts), 2048)
    bins = search.run()
    assert search.exchanges > 1500 and bins.total() < 637 and better_exchange(bins, 2048) is None


def test_the_search_packs_the_table(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        counts.update([2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))
    plan = Plan(counts, 2048)
    assert plan.sequences == 442 and plan.exchanges > 600


def test_swaps_empty_bins():
    assert swap_search(Counter({((6, 1), (2, 1)): 1, ((5, 1), (3, 1)): 1, ((2, 2),): 1}), 10).total() == 2
    assert swap_search(Counter({((7, 1),): 2, ((3, 2),): 1}), 10).total() == 2


def pieces(rows, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            out.append((i, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def check(spark, rows, capacity):
    got = brute.rows(pack(brute.documents(spark, rows), capacity))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces(rows, capacity)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    sequences = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= capacity
    return len(sequences), -(-sum(sequences.values()) // capacity)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([None, "", "word", "word " * rng.randrange(1, 300), " ".join(f"w{rng.randrange(9**6)}" for _ in range(rng.randrange(80)))])) for k in range(400)]
    used, least = check(spark, rows, 64)
    assert used <= least + 1
    check(spark, [(1, "a"), (1, "a"), (2, "b c")], 2048)
    assert pack(brute.documents(spark, [])).count() == 0
    assert pack(brute.documents(spark, [(None, "a")]), with_ids=False).collect()[0]["length"] == 2
