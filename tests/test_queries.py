"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    out = check(spark, con, name, SF, QUERIES, ORACLE)
    assert out.startswith("ok"), out


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 3  # few brands trade on the last date of the smallest tables


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
