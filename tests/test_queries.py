"""Every query against its SQL on the small scale."""

import pytest
from check import compare

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir, con):
    assert compare(QUERIES[name](spark, sf_dir), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["match_id", "possession", "sequence_length", "goal", "terminal"]
    assert df.count() > 0


def test_sql_keys_are_queries():
    assert set(SQL) <= set(QUERIES)
