"""Plain Python forms of the contracts, for small inputs."""

import hashlib
import re

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def documents(spark, rows_):
    """rows_: (doc_id, text) pairs, as a documents table with further columns whose names clash with inner ones."""
    return spark.createDataFrame(
        [(i, t, "en", "src0", len(t) if t is not None else None, 7, "x") for i, t in rows_],
        "doc_id long, text string, lang string, source string, n_chars long, id long, chunk string",
    )


def op1(rows_, window=13):
    split = [(i, BLANK_WORD.findall(t or "")) for i, t in rows_]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def op2(rows_):
    out = []
    for i, t in rows_:
        t = t or ""
        w = BLANK_WORD.findall(t)
        lines = [x for x in t.split("\n") if BLANK_WORD.search(x)]
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeat = {p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w)))
    return sorted(out)


def longest_repeats(w, least):
    """For each word the longest substring from there that occurs again."""
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= least else 0)
    return out


def alnum(t):
    return ALNUM_WORD.findall((t or "").translate(LOWER))


def op3(rows_, items_, window=10):
    windows = {}
    for item, t in items_:
        w = alnum(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    sizes = sorted({len(k) for k in windows})
    out = []
    for i, t in rows_:
        w, hit, items = alnum(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                if g in windows:
                    hit.update(range(k, k + n))
                    items |= windows[g]
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return sorted(out)

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def op10(rows_):
    out = []
    for i, t in rows_:
        w, at, labels = alnum(t), [], set()
        for p, label in PHRASES.items():
            p = p.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return sorted(out)


def components(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def op7(rows_, size=2, percent=80):
    sets = {}
    for i, t in rows_:
        w = BLANK_WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    label = components(ids, links)
    return [(i, len(sets[i]), label[i], label[i] == i) for i in ids]


def _luhn(d):
    return sum((int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and _luhn(re.sub(r"[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
}


def op5_spans(text):
    return [(m.start(), k, m.end(), kind) for k, (kind, (p, good)) in enumerate(KINDS.items()) for m in re.finditer(p, text) if good(m[0])]


def op5(rows_):
    out = []
    for i, t in rows_:
        spans = op5_spans(t or "")
        n = [sum(s[1] == k for s in spans) for k in range(4)]
        out.append((i, *n, sha(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(spans)))))
    return sorted(out)
