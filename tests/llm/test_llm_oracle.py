"""Queries with SQL equal it on the sf0.001 tables."""

import pytest

from oracle_check import compare, duck
from vessel_flow.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert ok, msg
