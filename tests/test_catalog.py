"""Every registered query against its SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from hostloom.plans import catalog
from hostloom.session import configure

PYTHON_STAGE = re.compile("ArrowEvalPython|MapInPandas|MapInArrow|BatchEvalPython|FlatMapGroupsInPandas")
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    frame = QUERIES[name](configure(spark), small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not PYTHON_STAGE.search(plan) and "CartesianProduct" not in plan
    got = rows_of(frame.columns, frame.collect())
    if name not in ORACLES:
        assert frame.columns
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
