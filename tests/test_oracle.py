"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from siltstone.plans import registry

FOLDER = "/root/testdata/sf0.001"
SLOW = {"forest_oof", "boosting_oof", "permutation_importance", "model_recommendation", "fitted_advice"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool):
        return float(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, rows) == table(columns, found.fetchall())


def test_entry_names_every_query(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
