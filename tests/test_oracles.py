"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ORACLES = __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_distinct_titles_of_odd_texts(spark, tmp_path):
    """Only space, line feed and tab are trimmed; nothing becomes null, and an article of a far year stays."""
    texts = ["", " ", "nan", "None", "<NA>", "\xa0x", "x\r", "\x0bx", "x\u3000", "x\x85", "\u2028q", None, " plain\n", "plain", "\tplain "]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, 'en', 's')", [*enumerate(texts), (2_400_000, "far")])
    c.execute("CREATE TABLE pages AS SELECT i AS page_id, 'http://a.example/' || i AS url FROM range(5) t(i)")
    for t in ("documents", "pages"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = [r[0] for r in __spark_entry__.queries()["distinct_titles"](spark, str(tmp_path)).collect()]
    want = [r[0] for r in c.execute(ORACLES["distinct_titles"]).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {"", "nan", None, "plain", "far"} <= set(got)
