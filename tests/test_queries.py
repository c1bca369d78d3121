"""Every named query with a SQL counterpart gives the same rows in DuckDB."""

import pytest

import check_queries
from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return check_queries.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, small, name):
    note, ok, _ = check_queries.compare(spark, con, small, name, queries()[name], SQL[name])
    assert ok, note


def test_names_agree():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert {"job_id", "is_skewed", "num_tasks", "template_id"} <= set(df.columns)
    assert df.count() > 0
