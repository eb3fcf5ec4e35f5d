"""Every registered query against its SQL on the shared tables."""

import catalog
import pytest
from compare import connect, differences

QUERIES, SQL = catalog.all_queries(), catalog.all_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_names_are_unique_and_sql_belongs_to_queries():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in catalog.MODULES)
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
