"""Every query against its SQL, on the driver's smallest tables."""

import pytest
from conftest import rows

from marketlens.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf)) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:5] == ["state", "district", "market", "commodity", "variety"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_approximate_bounds_are_close(spark, sf):
    exact = {r["commodity"]: r for r in QUERIES["outlier_bounds"](spark, sf).collect()}
    for r in QUERIES["outlier_bounds_approx"](spark, sf).collect():
        assert abs(r["median"] - exact[r["commodity"]]["median"]) <= 0.02 * exact[r["commodity"]]["median"]
