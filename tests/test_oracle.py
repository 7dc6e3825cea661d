"""Every query with an SQL twin gives the same rows, on whole tables at the smallest scale."""

import oracle
import pytest

from inkframe.plans import BUILDS, ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equal_to_sql(spark, con, name):
    assert oracle.compare(spark, con, name, BUILDS[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("name", [n for n in BUILDS if n not in ORACLES])
def test_runs(spark, name):
    assert BUILDS[name](spark, SF_DIR).count() > 0
