"""Every registered query of the engine's own operators: against SQL where there is some, else that it has rows."""

from __future__ import annotations

import pytest

from parley.plans import QUERIES, SQL

from .compare import DATA, assert_same, connection


@pytest.fixture(scope="module")
def db():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    assert_same(QUERIES[name](spark, DATA), SQL[name], db)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(set(found.columns)) == len(found.columns)
    found.write.format("noop").mode("overwrite").save()


def test_names_of_sql_are_queries():
    assert set(SQL) <= set(QUERIES)
