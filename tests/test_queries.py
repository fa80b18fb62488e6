"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import decimal

import duckdb
import pytest

from sievebank.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x):
    if x is None or x != x:
        return "null"
    return f"{x:.9g}" if isinstance(x, (float, decimal.Decimal)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in order) for r in want.fetchall())


def test_other_queries_run(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, SF).columns
