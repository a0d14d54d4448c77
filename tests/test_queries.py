"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from sluice.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted(tuple(plain(v) for v in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert got == want
