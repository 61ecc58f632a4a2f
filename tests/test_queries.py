"""Every query against its SQL on the smallest tables; the others must run and keep their invariants."""

import pytest

from nearfold.plans import catalog_queries

from .oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog_queries.queries(), catalog_queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = connect(FOLDER)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, duck):
    assert same(QUERIES[name], ORACLE[name], spark, FOLDER, duck) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
