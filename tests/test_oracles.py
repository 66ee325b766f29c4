"""Every registered query that SQL can express equals its DuckDB SQL on the same tables."""

import os

import duckdb
import pytest

from quarry.plans import oracles, registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def _rows(rows):
    return sorted((tuple(round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_oracle(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    expected = duck.sql(oracles.SQL[name])
    assert columns == sorted(expected.columns)
    assert _rows(df.select(*columns).collect()) == _rows(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_other_query_runs(spark, sf):
    for name in sorted(registry.queries().keys() - oracles.SQL.keys()):
        assert registry.queries()[name](spark, sf).count() > 0, name
