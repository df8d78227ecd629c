"""Every registered query against its SQL twin (or for rows, where it has none)."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, note = check(spark, con, name, SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, con, name):
    ok, note = check(spark, con, name, SF)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
