"""Every registered query of the recruitment operators against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from hireframe.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    rel = duck.sql(sql)
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
