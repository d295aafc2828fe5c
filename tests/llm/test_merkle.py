import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm.merkle import FIELDS, fold, leaf_digest, merkle_manifest, proof_digest

from . import brute

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node int, place int, part int, c0 string, c1 string, path int, child int, id int, root int"


def leaf(values):
    return brute.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The top of a list of digests, and for each of them the siblings (before, after) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        for path, p in zip(paths, at, strict=True):
            run = runs[p // fanout]
            path.append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        nodes, at = [brute.sha("".join(r)) for r in runs], [p // fanout for p in at]
    return (nodes or [None])[0], paths


def expected(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0], leaf(r[:5])))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    tops = {}
    for k in keys:
        groups[k].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        tops[k] = climb([x[2] for x in groups[k]], fanout)
    root, over = climb([tops[k][0] for k in keys], fanout)
    out = []
    for k, above in zip(keys, over, strict=True):
        for (_, i, digest), path in zip(groups[k], tops[k][1], strict=True):
            out.append((i, digest, tops[k][0], root, path + above))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, "a", "b", 4, 5, 6, 7) for r in rows], SCHEMA)


def check(spark, rows, fanout):
    docs = table(spark, rows)
    made = merkle_manifest(docs, fanout=fanout)
    got = brute.rows(made.proofs)
    want = expected(rows, fanout)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["path"]]) for r in got), key=repr) == want
    folded = made.proofs.select(proof_digest(F.col("path")).alias("p"), (fold(F.col("path"), F.col("leaf")) == F.col("root")).alias("same"), (fold(F.col("path"), F.lit("0")) == F.col("root")).alias("other"))
    assert sorted((r["p"], r["same"], r["other"]) for r in brute.rows(folded)) == sorted((brute.sha("".join(a + b for a, b in w[4])), True, False) for w in want)
    return made


def test_equals_brute_force(spark):
    rng = random.Random(2)
    sources = ["a"] * 40 + ["b", "é", "z", "", None, "B"]
    rows = [(k * 3 - 20, rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 7]), rng.choice([None, "", "text é", f"t{k}"])) for k in range(150)]
    rows += rows[:9] + [(None, "a", None, None, None), (None, None, None, None, "x"), (None, "a", None, None, None), (rows[0][0], rows[0][1], "fr", 1, "another text of a repeated id")]
    check(spark, rows, 3)
    made = check(spark, rows, 16)
    levels = {(r["over_groups"], r["level"]): r["n"] for r in brute.rows(made.nodes.groupBy("over_groups", "level").agg(F.count("*").alias("n")))}
    assert levels[(False, 0)] == len(rows) and levels[(True, 0)] == len({r[1] for r in rows})


def test_a_group_of_its_own_for_every_row(spark):
    check(spark, [(k, f"s{k:03}", "en", k, "same") for k in range(40)], 4)


def test_one_row_and_none(spark):
    check(spark, [(5, "s", "en", 3, "abc")], 16)
    none = merkle_manifest(table(spark, []))
    assert none.proofs.count() == 0 and none.nodes.count() == 0


def test_changed_values_are_found(spark):
    rows = [(k, "s", "en", 1, f"Text {k}" if k % 2 else f"text {k}") for k in range(50)]
    claimed = [F.lower(c) if c == "text" else F.col(c) for c in FIELDS]
    proofs = merkle_manifest(table(spark, rows), carry={"claimed": leaf_digest(claimed)}).proofs
    got = {r["doc_id"]: r["same"] for r in brute.rows(proofs.select("doc_id", (fold(F.col("path"), F.col("claimed")) == F.col("root")).alias("same")))}
    assert got == {k: k % 2 == 0 for k in range(50)}


def test_long_text_and_other_fields(spark):
    rows = [(1, "s", "en", 1, "é" * 500_000), (2, "s", "en", 1, "b")]
    check(spark, rows, 16)
    few = merkle_manifest(table(spark, rows), fields=["text"], id_col="n_chars", group_col="lang").proofs
    assert {r["leaf"] for r in brute.rows(few)} == {leaf([r[4]]) for r in rows}
