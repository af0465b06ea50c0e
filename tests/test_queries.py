"""Every core query with SQL gives DuckDB's rows; every other one runs and has a stable schema."""

import os

import oracle
import pytest

from weft.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables here")
QUERIES = registry.core()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    run, sql = QUERIES[name]
    got = run(spark, oracle.DATA)
    if sql:
        assert oracle.rows(got.toArrow()) == oracle.rows(duck.execute(sql).to_arrow_table())
    else:
        assert got.toArrow().schema.names == got.columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
