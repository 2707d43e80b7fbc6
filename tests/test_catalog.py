import pytest

import __spark_entry__ as entry
from tests.comparing import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", entry.queries())
def test_query_agrees_with_sql(spark, connection, name):
    rows, problem = compare(entry.queries()[name](spark, SF_DIR), connection, SQL.get(name))
    assert problem is None
    assert rows > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["is_fraud", "count"]
    assert result.agg({"count": "sum"}).head()[0] > 3900
