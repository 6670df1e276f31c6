"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest
from oracle import connect, differences

from gneiss.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, con, name):
    assert differences(spark, QUERIES[name], ORACLES[name], SF, con) is None


def test_entry_gives_a_row(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
