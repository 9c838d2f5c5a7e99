"""Every registered query runs, and agrees with its SQL where it has any."""

import pytest
from oracle import connect, differences

import __spark_entry__
from loomspark.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
