"""Every registered query runs and, where there is SQL for it, gives the same rows."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import rows

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def base(data):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql("set timezone = 'UTC'")
    for file in os.listdir(data):
        connection.sql(f"create view {file.split('.')[0]} as select * from '{data}/{file}'")
    return connection


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, base, name):
    frame = QUERIES[name](spark, data)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    mine = rows(frame.columns, frame.collect())
    if name not in SQL:
        assert mine
        return
    result = base.sql(SQL[name])
    assert sorted(frame.columns) == sorted(result.columns)
    assert mine == rows(result.columns, result.fetchall())


@pytest.mark.parametrize("name", ["price_file", "merge_chunks", "write_progress"])
def test_query_writes_to_a_shared_folder_of_a_cluster(spark, data, base, name, monkeypatch):
    """A session of a cluster whose shared folder is a mount, a plain ``file:`` folder to Spark."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    frame, result = QUERIES[name](spark, data), base.sql(SQL[name])
    assert rows(frame.columns, frame.collect()) == rows(result.columns, result.fetchall())


def test_entry(spark, data):
    assert entry.entry(spark).count() == 11
