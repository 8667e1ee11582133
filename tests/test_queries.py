"""Every registered query against its DuckDB counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck
from veilspan.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY: set[str] = set()
QUERIES, SQLS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(SQLS) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    out = check(spark, con, name, QUERIES[name], SQLS[name], SF_DIR)
    assert out is None or (out.startswith("EMPTY") and name in MAY_BE_EMPTY), out


def test_entry(spark):
    assert entry.entry(spark).count() > 0
