"""Every query with SQL agrees with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools import check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, database, name):
    text, good = check.compare(spark, database, FOLDER, name, entry.oracle_sql()[name], entry.queries()[name])
    assert good, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
