"""Every registered query against its DuckDB text on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from kontor.catalog import base

SF = os.environ.get("KONTOR_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_check():
    assert set(base.QUERIES) == set(base.ORACLES)
    assert set(base.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], con) == []
