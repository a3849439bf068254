"""Queries of this subpackage against their SQL, and the registry."""

import pytest
from conftest import rows

from marketlens.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf)) == rows(duck.sql(ORACLES[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, sf, tmp_path, name):
    import os

    for t in os.listdir(sf):
        spark.read.parquet(f"{sf}/{t}").limit(0).write.parquet(str(tmp_path / t))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
