"""All queries of the catalogue against DuckDB on the smallest tables."""

import pytest

from comparison import connect, differences
from taxolens.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert not differences(catalogue.queries()[name](spark, FOLDER), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_has_rows(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
