"""Every registered query that has SQL gives the same rows and types as that SQL."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert difference(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
