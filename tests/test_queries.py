"""Queries against their SQL twins on the smallest tables."""

import os

import pytest

from stagewise import plans
from stagewise.plans.base import rounded
from tests.compare import connection, difference

SF = "/root/testdata/sf0.001"
NAMES = sorted(plans.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_oracle_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = plans.queries()[name](spark, SF).toPandas()
    assert difference(got, con.sql(plans.oracle_sql()[name]).df()) == ""


def test_doubles_are_rounded_as_the_sql_does(spark, con):
    """Decimals that end in a 5 have doubles on either side of it; to the bit, not within a tolerance."""
    values = [0.1261975, 0.1265315, -0.1261975, 0.0000005, 0.0078125, 1234.5678905, 0.3, 0.0, 1e300, *[(k + 0.5) / 1e6 for k in range(2000)]]
    got = rounded(spark.createDataFrame([(x,) for x in values], "x double")).toPandas()["x"].tolist()
    want = [con.sql(f"SELECT round(CAST({x!r} AS DOUBLE), 6) AS x").df()["x"][0] for x in values[:9]]
    want += con.sql("SELECT round((k + 0.5) / 1e6, 6) AS x FROM range(2000) t(k) ORDER BY k").df()["x"].tolist()
    assert got == want
