import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    ok, note, rows = compare.compare(spark, duck, queries()[name], SQL.get(name), sf_dir)
    assert ok, note
    assert rows > 0


def test_entry(spark):
    assert entry(spark).count() > 0
