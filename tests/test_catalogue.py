import pytest

from gridway.plans import catalogue
from oracle import SMALL, expected, rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, name):
    found = rows(catalogue.QUERIES[name](spark, SMALL).toPandas())
    wanted = rows(expected(catalogue.ORACLES[name]))
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
