import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import words as W
from tidemark.llm.license_templates import PHRASES, Automaton, license_scan, word_hashes
from tidemark.llm.license_texts import TEMPLATES

from . import brute


def cases():
    rng = random.Random(9)
    parts = ["GNU", "General Public", "License", "the Apache License", "CC-BY", "cc by", "MIT", "license.", "x", "É", "apache", "gnu general public license"]
    return list(enumerate([" ".join(rng.choices(parts, k=rng.choice([0, 3, 12, 50]))) for _ in range(80)] + ["", None, "mit", "license", "!?"]))


def test_base_equals_brute_force(spark):
    got = license_scan(brute.documents(spark, cases())).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == brute.op10(cases())


def test_templates(spark):
    templates = {"t": "copy of <<var;words=1-2>> is<<beginOptional>> hereby<<endOptional>> allowed"}
    texts = {
        1: "A copy of it is allowed.", 2: "copy of the work is hereby allowed", 3: "copy of is allowed", 4: "copy of a b c is allowed",
        5: "copy of it is not allowed", 6: "copy of it is hereby hereby allowed", 7: "copy of it", 8: None, 9: "copy of copy of it is allowed",
    }
    got = {r["doc_id"]: (r["labels"], [tuple(m) for m in r["matches"]], r["score"]) for r in license_scan(brute.documents(spark, list(texts.items())), phrases={}, templates=templates).collect()}
    assert got[1] == ("t", [("t", 1, 6)], 5 / 6) and got[2] == ("t", [("t", 0, 7)], 1.0)
    assert all(got[k][0] == "" for k in (3, 4, 5, 6, 7, 8)) and got[8][2] == 0.0
    assert got[9][1] == [("t", 2, 7)]


def test_compile_errors_and_nesting():
    for bad in ("a <<beginOptional>>b", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>", "<<var;words=0-3>>"):
        with pytest.raises(ValueError):
            Automaton.compile(bad)
    nested = Automaton.compile("a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d")
    for text, took in (("a d", 2), ("a b d", 3), ("a b c d", 4), ("a c d", 0), ("a b c", 0)):
        assert nested.match(word_hashes(text)) == took


def test_shipped_templates_accept_their_own_wording(spark):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
        (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "Released under the MIT License."), (5, "Licensed under the Apache License, Version 2.0."),
    ]
    got = {r["doc_id"]: r["labels"] for r in license_scan(brute.documents(spark, rows)).collect()}
    assert got == {1: "mit-opening", 2: "gpl,gpl-statement", 3: "cc-by,cc-by-statement", 4: "mit,mit-statement", 5: "apache,apache-statement"}
    assert license_scan(brute.documents(spark, [])).count() == 0


def as_pattern(template):
    """A template over words joined by blanks, as a regular expression."""
    out, marks = "", re.compile(r'<<(beginOptional|endOptional|var[^>]*)>>')
    at = 0
    for m in [*marks.finditer(template), None]:
        out += "".join(f"{w} " for w in brute.alnum(template[at : m.start() if m else len(template)]))
        if m is None:
            return out
        at = m.end()
        if m[1] == "beginOptional":
            out += "(?:"
        elif m[1] == "endOptional":
            out += ")?"
        elif counted := re.search(r"words=(\d+)-(\d+)", m[1]):
            out += f"(?:[^ ]+ ){{{counted[1]},{counted[2]}}}"
        elif spanned := re.search(r"\.\{(\d+),(\d+)\}", m[1]):
            region = f"[^ ](?:.{{0,{int(spanned[2]) - 2}}}[^ ])? "
            out += region if int(spanned[1]) else f"(?:{region})?"
        else:
            out += "(?:[^ ]+ )+"


def example(template, rng, change=None):
    """Words that a template takes; change: one mandatory word becomes another."""
    text = re.sub(r"<<var[^>]*>>", lambda m: " other" * (2 if "words=0-2" not in m[0] and "words=1-2" in m[0] else 1) + " ", template)
    while "<<begin" in text:
        text = re.sub(r"<<beginOptional>>((?:(?!<<)[\s\S])*)<<endOptional>>", lambda m: m[1] if rng.random() < 0.5 else " ", text)
    words = text.split()
    if change is not None:
        words[int(change * len(words))] = "altered"
    return " ".join(words)


def longest(pattern, words, at):
    """The most words from there that the pattern takes."""
    text = " ".join([*words[at:], ""])
    ends = [m for k in range(len(words), at, -1) if (m := re.fullmatch(pattern, " ".join([*words[at:k], ""])))] if re.match(pattern, text) else []
    return len(ends[0][0].split()) if ends else 0


def test_labels_and_score_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k, (label, template) in enumerate(sorted(TEMPLATES.items())):
        rows.append((10 * k, example(template, rng)))
        rows.append((10 * k + 1, f"Copyright (c) 2020 Someone. {example(template, rng)} and then {example(template, rng, rng.choice([0.3, 0.6, 0.9]))}"))
        rows.append((10 * k + 2, example(template, rng, 0.97)))
    rows += [(1000, None), (1001, "nothing"), (1002, "apache license " * 5)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan(brute.documents(spark, rows)).collect()}
    patterns = {label: (as_pattern(t), re.split(r"<<", t)[0].split()) for label, t in TEMPLATES.items()}
    seen = set()
    for i, t in rows:
        w = brute.alnum(t)
        spans = [(k, k + len(p.split()), label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        for label, (pattern, head) in patterns.items():
            head = brute.alnum(" ".join(head))[:3]
            spans += [(k, k + n, label) for k in range(len(w)) if w[k : k + len(head)] == head and (n := longest(pattern, w, k))]
        covered = {p for s, e, _ in spans for p in range(s, e)}
        assert got[i] == (",".join(sorted({x[2] for x in spans})), len(covered) / max(len(w), 1)), (i, t)
        seen |= {x[2] for x in spans}
    assert set(TEMPLATES) <= seen


def test_regions_of_the_markup():
    a = Automaton.compile('shall <<var;name="x";original="THE AUTHORS";match=".+">> be <<var;match=".{0,20}">> liable')
    for text, took in (("shall we be liable", 4), ("shall we and all be not at all liable", 9), ("shall be liable", 0), ("shall be be liable", 4)):
        assert a.match(word_hashes(text)) == took
    for bad in ('a <<var;match="(x|y)">>', "a <<var;name=x>>"):
        with pytest.raises(ValueError):
            Automaton.compile(bad)


ISC, BSD = TEMPLATES["isc-license"], TEMPLATES["bsd-2-license"]


def found(spark, *texts):
    rows = license_scan(brute.documents(spark, list(enumerate(texts)))).collect()
    return [{m["label"]: m["last"] - m["first"] for m in r["matches"]} for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_long_names_and_long_bullets(spark):
    plain = lambda t, names: re.sub(r"<<var[^>]*>>", lambda m: next(names), t).replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    name = " ".join(f"holder{k}" for k in range(450))
    isc = plain(ISC, iter([name, "us"]))
    bsd = plain(BSD, iter(["1.", "2.", " ".join(["x"] * 900), "us"]))
    crowded = plain(BSD, iter(["1.", "2. " + "another condition holds " * 45, "us", "us"]))
    short = plain(BSD, iter(["(a) of these", "b", "us", "us"]))
    got = found(spark, isc, "start " + bsd + " end", crowded, short)
    assert got[0]["isc-license"] == len(brute.alnum(isc)) > 550
    assert got[1]["bsd-2-license"] == len(brute.alnum(bsd)) > 1050
    assert "bsd-2-license" not in got[2] and got[2]["bsd-opening"]
    assert got[3]["bsd-2-license"] == len(brute.alnum(short))


def test_spans_count_characters():
    a = Automaton.compile('shall <<var;match=".{3,8}">> be')
    for text, took in (("shall abc be", 3), ("shall ab be", 0), ("shall é, 𝄞é be", 4), ("shall abcdefghi be", 0), ("shall a b c d be", 6), ("shall a b c d e be", 0), ("shall be", 0)):
        data, bounds = W.buffers(pa.array([text]))
        w = W.split_words(data, bounds, W.ALPHANUMERIC)
        count = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        assert a.match(w.hashes(lower=True), count[w.starts], count[w.ends]) == took == a.matches(w.hashes(lower=True), count[w.starts], count[w.ends], [0])[0]


def test_nested_hits_of_a_template_count_once(spark):
    row = license_scan(brute.documents(spark, [(1, "Released under the MIT License. Released under the terms of the MIT License.")])).first()
    assert [(m["label"], m["first"], m["last"]) for m in row["matches"] if m["label"] == "mit-statement"] == [("mit-statement", 0, 5), ("mit-statement", 5, 13)]


def test_many_openings_in_a_long_text_are_one_pass(spark):
    text = " ".join(["Permission is hereby granted, free of charge, to any person"] * 3000) + " " + ISC
    assert found(spark, text)[0].keys() <= {"isc-opening", "isc-license", "mit-opening"}
