"""Every query of the library proper against its SQL in DuckDB."""

import decimal
import math

import duckdb
import pytest

from tracefold.plans import registry

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in df.columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in rows), key=str) == expected


def test_entry():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
