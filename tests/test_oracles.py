"""Every query against its SQL, on the same tables."""

import math
import os

import duckdb
import pytest

from cadenza.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def _rows(frame):
    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else float(v) if isinstance(v, float) else v
    return columns, sorted((tuple(clean(v) for v in row) for row in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    columns, rows = _rows(catalog.QUERIES[name](spark, sf_dir).toPandas())
    want_columns, want = _rows(duck.execute(catalog.ORACLE_SQL[name]).df())
    assert columns == want_columns and len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 2e-7) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    assert frame.columns and len(set(frame.columns)) == len(frame.columns)
    frame.collect()
