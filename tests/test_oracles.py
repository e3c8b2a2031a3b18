"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from strideframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    want = [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in want]
    key = lambda r: tuple((x is None, type(x).__name__ if not isinstance(x, (int, float)) else "n", repr(round(x, 3)) if isinstance(x, float) else repr(x)) for x in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
