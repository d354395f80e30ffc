"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from checking import duck, same

from hirelake.plans import all_queries, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert all_queries.FLAGSHIP(spark, SF).count() == 1
