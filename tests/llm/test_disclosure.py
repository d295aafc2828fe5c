import random

from tidemark.llm.disclosure import sanitise

from . import brute

COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def card(rng):
    d = [rng.randrange(10) for _ in range(15)]
    return next("".join(map(str, d)) + str(c) for c in range(10) if brute._luhn("".join(map(str, d)) + str(c)))


def cases():
    rng = random.Random(12)
    texts = ["", None, "a@b.c@d.e+y@f.g", "x.y%z@host-1.co.uk.", "@a.b a@b a@.b", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.1.1.1 0000000000000000000000001.2.3.4", "12345678901234567890.1.1.1",
             "+1 (555) 010-9999 +12 +1 555", "+33 1 23 45 67 89, +1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111 4111-1111-1111-1111", "4111  1111 1111 1111", "é 4111111111111111é", "1" * 5000, "a" * 50000, "a." * 9000 + "@", "1-" * 4000,
             "+" + "1 " * 4000, "𝄞 a@b.cc 𝄞 1.1.1.1"]
    bits = ["a", "b@", "c.d", ".", "1", "22", "+", "-", " ", "(", ")", "é", "@", "x1@y2.z", "3.4.5.6", "+4", "\n"]
    for _ in range(150):
        t = "".join(rng.choices(bits, k=rng.choice([5, 40, 200])))
        c = card(rng)
        at = rng.randrange(len(t) + 1)
        texts.append(t[:at] + rng.choice([c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}", f"+{c[:11]}"]) + t[at:])
    return list(enumerate(texts))


def test_base_equals_brute_force(spark):
    got = {r[0]: tuple(r) for r in sanitise(brute.documents(spark, cases())).select(COLUMNS).collect()}
    for want in brute.op5(cases()):
        assert got[want[0]] == want, cases()[want[0]][1][:300]


def test_disclosing_terms(spark):
    rows = [(k, f"Visit number {k}: mail to boss@firm.example about Zanzibar and the common things, w{'abcdefghij'[k] * 3}.") for k in range(6)]
    rows += [(k, f"nothing but the common things here and about, visit mail number w{k}") for k in range(10, 60)]
    rows += [(90, "Zanzibar alone far from any entity"), (91, None), (92, "")]
    got = {r["doc_id"]: r for r in sanitise(brute.documents(spark, rows), with_text=True, remove_at=2.0).collect()}
    start = rows[0][1].index("Zanzibar")
    for k in range(6):
        assert f"term:{start}:{start + 8}" in got[k]["spans"].split(",") and got[k]["n_email"] == 1
        assert "[EMAIL]" in got[k]["clean_text"] and "Zanzibar" not in got[k]["clean_text"] and "common things" in got[k]["clean_text"]
    assert all(got[k]["spans"] == "" and got[k]["clean_text"] == dict(rows)[k] for k in (*range(10, 60), 90, 91, 92))


def test_copies_do_not_count_as_support(spark):
    rows = [(k, "Reach Quentin at me@home.example now") for k in range(5)] + [(k, "something else") for k in range(10, 40)]
    assert {r["spans"] for r in sanitise(brute.documents(spark, rows)).where("doc_id < 10").collect()} == {"email:17:32"}


def test_removal_ids_and_empty_table(spark):
    rows = [(None, "ip 10.0.0.1 +12345678901 x"), (1, "ip 10.0.0.1 +12345678901 x"), (1, "ip 10.0.0.1 +12345678901 x"), (1, "é@é")]
    got = [(r["doc_id"], r["clean_text"]) for r in sanitise(brute.documents(spark, rows), with_text=True).collect()]
    assert sorted(got, key=str) == sorted([(None, "ip [IP] [PHONE] x"), (1, "ip [IP] [PHONE] x"), (1, "ip [IP] [PHONE] x"), (1, "é@é")], key=str)
    assert sanitise(brute.documents(spark, [])).count() == 0


def test_one_text_is_no_evidence_and_several_are(spark):
    far = "the common things go on and on " * 20
    rows = [(1, f"Zebulon wrote ZEBULON {far} mail to one@firm.example, Quentin's.{far}Zebulon"), (2, f"ip 10.0.0.1 éQuentin@firm.example {far}")]
    rows += [(k, f"{far} with Quentin number {k}") for k in range(10, 210)]
    alone = {r["doc_id"]: r for r in sanitise(brute.documents(spark, rows), with_text=True).collect()}
    assert {r["n_term"] for r in alone.values()} == {0} and "Zebulon" in alone[1]["clean_text"]
    rows += [(3, f"again Zebulon and one@firm.example {far}"), (4, f"one@firm.example sent zebulon {far} more")]
    got = {r["doc_id"]: r for r in sanitise(brute.documents(spark, rows), with_text=True, remove_at=2.0).collect()}
    text = rows[0][1]
    want = [f"term:{k}:{k + 7}" for k in range(len(text)) if text[k : k + 7].lower() == "zebulon"]
    assert len(want) == 3 and [x for x in got[1]["spans"].split(",") if x.startswith("term")] == want
    assert got[1]["clean_text"].startswith("[NAME] wrote [ABBREVIATION] the common") and "Quentin" in got[1]["clean_text"] and got[1]["clean_text"].count("common things") == 40
    assert "[TERM]" in got[4]["clean_text"] and got[2]["n_term"] == 0 and all(got[k]["clean_text"] == dict(rows)[k] for k in range(10, 210))


def test_rare_harmless_words_and_parts_of_tokens_stay(spark):
    """Words of one text beside an email, and letters inside of longer tokens, whatever the corpus's size."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    for n in (50, 2000):
        rows = [(k, " ".join(word() for _ in range(20))) for k in range(n)] + [(n + k, f"{' '.join(word() for _ in range(30))} key 04abc91ab85687d33def9ac699 mail{k % 7}@host.example") for k in range(30)]
        got = sanitise(brute.documents(spark, rows), with_text=True).collect()
        assert sum(r["n_term"] for r in got) == 0 and all("04abc91ab85687d33def9ac699" in r["clean_text"] for r in got if r["doc_id"] >= n)


def test_planted_terms_are_caught_at_every_size(spark):
    """The bar doesn't depend on how many other texts there are."""
    rng = random.Random(8)
    for n in (100, 1000, 10_000):
        rows = [(k, " ".join(f"w{'abcdefghij'[rng.randrange(10)]}{'abcdefghij'[rng.randrange(10)]}x" for _ in range(12))) for k in range(n)]
        names = [f"Planted{'abcdefghij'[k] * 2}" for k in range(10)]
        rows += [(n + 10 * k + j, f"{names[k]} wbcx waax {j} user{k}@host.example {'wcdx ' * j}") for k in range(10) for j in range(4)]
        got = {r["doc_id"]: r for r in sanitise(brute.documents(spark, rows), with_text=True).where(f"doc_id >= {n}").collect()}
        caught = sum(names[k] not in got[n + 10 * k + j]["clean_text"] for k in range(10) for j in range(4))
        assert caught == 40 and all("waax" in r["clean_text"] for r in got.values())


def terms_by_brute_force(rows, z=1.2816, at=0.5, least=2, chance=0.01):
    """(doc_id, start, end, disclosure) of every term span; loops over entities and terms."""
    import math
    import re

    texts = {t or "" for _, t in rows}
    word = re.compile(r"(?<!\w)[^\W\d_]{3,}(?!\w)")
    spans = {t: brute.op5_spans(t) for t in texts}
    free = {t: [m for m in word.finditer(t) if not any(m.start() <= e and s <= m.end() for s, _, e, _ in spans[t])] for t in texts}
    norm = {"email": str.lower, "ip": str, "card": lambda m: re.sub("[^0-9]", "", m), "phone": lambda m: re.sub("[^0-9]", "", m)}
    held = {t: {k + ":" + norm[k](t[s:e]) for s, _, e, k in spans[t]} for t in texts}
    with_term, beside = {}, {}
    for t in texts:
        for w in {m[0].lower() for m in word.finditer(t)}:
            with_term[w] = with_term.get(w, 0) + 1
        for w in {m[0].lower() for m in free[t] if held[t]}:
            beside.setdefault(w, set()).add(t)
    entities = {e: frozenset(t for t in texts if e in held[t]) for e in set().union(*held.values())}
    known, tried = [], set()
    for e, its in entities.items():
        for w, near in beside.items():
            both, n, k = len(near & its), with_term[w], len(its)
            if both and k >= least and len(near) >= least and n <= k / at:
                tried.add((its, frozenset(near), n))
                p, expected = both / n, n * k / len(texts)
                low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                if both >= least and low >= at and both > expected:
                    known.append((its, w, low, both - expected - both * math.log(both / expected)))
    found = {}
    for its, w, low, log_p in known:
        if log_p + math.log(len(tried)) <= math.log(chance):
            for t in its:
                found[t, w] = max(found.get((t, w), 0), low)
    return [(i, m.start(), m.end(), found[t or "", m[0].lower()]) for i, t in rows for m in free[t or ""] if (t or "", m[0].lower()) in found]


def test_disclosure_equals_brute_force(spark):
    rng = random.Random(4)
    common = [f"{a}{b}" for a in ("stone", "river", "cloud", "field") for b in ("ing", "ed", "er", "")]
    rare = [f"{a}{b}" for a in ("zanor", "quori", "velta", "brimo", "doskl") for b in ("ing", "ed", "oth", "ux")]
    people = [f"user{k}@host.example" for k in range(6)] + ["10.1.2.3", "+44 20 7946 0958"]
    rows = []
    for k in range(160):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 60))]
        if k % 4 == 0:
            p = rng.randrange(len(people))
            words += [people[p], rare[2 * p].title() if k % 8 else rare[2 * p], rng.choice(rare), rng.choice([people[p], "x" + people[p], "Tel" + people[p]])] * rng.choice([1, 3])
        elif k % 9 == 0:
            words.append(rng.choice(rare))
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    rows += [(200, rows[0][1]), (201, rows[4][1]), (202, None)]
    kinds = set()
    for remove_at in (0.6, 2.0):
        got = {r["doc_id"]: r for r in sanitise(brute.documents(spark, rows), with_text=True, remove_at=remove_at).collect()}
        terms = terms_by_brute_force(rows)
        assert len(terms) > 20
        for i, t in rows:
            base = brute.op5_spans(t or "")
            own = [(s, 4, e, "term", d) for j, s, e, d in terms if j == i]
            want = sorted([*((*b, 0) for b in base), *own])
            assert got[i]["spans"] == ",".join(f"{k}:{s}:{e}" for s, _, e, k, *_ in want) and got[i]["n_term"] == len(own)
            out, done = [], 0
            for s, _, e, k, d in want:
                if s >= done:
                    put = f"[{k.upper()}]" if k != "term" else "" if d >= remove_at else "[NAME]" if t[s].isupper() else "[TERM]"
                    kinds.add(put)
                    out += [t[done:s], put]
                done = max(done, e)
            assert got[i]["clean_text"] == (None if t is None else "".join([*out, t[done:]])), i
    assert {"[EMAIL]", "[IP]", "[PHONE]", "[NAME]", "[TERM]", ""} <= kinds


def test_many_valid_matches(spark):
    n = 50_000
    text = " ".join(f"name{'abcdefghij'[k % 10]} wrote u{k}@host{k % 50}.example.org and" for k in range(n))
    got = {r["doc_id"]: r for r in sanitise(brute.documents(spark, [(1, text), (2, "and nothing wrote it"), (3, "so it goes")]), with_text=True, remove_at=2.0).collect()}
    assert got[1]["n_email"] == n and got[1]["clean_text"].count("[EMAIL]") == n and "@" not in got[1]["clean_text"]
    assert got[1]["spans"].count("email:") == n and got[2]["spans"] == "" and got[2]["clean_text"] == "and nothing wrote it"
