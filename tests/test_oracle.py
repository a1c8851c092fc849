"""Every registered query equals its DuckDB SQL on the sf0.001 tables."""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from vessel_flow.plans.queries import ORACLE, SPARK

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/events.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, SPARK[name], ORACLE[name], SF)
    assert ok, msg


def test_every_query_has_oracle():
    assert set(SPARK) == set(ORACLE) and set(SPARK) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert {"MMSI", "start_state", "end_state", "total_emissions", "state_emissions_json"} <= set(df.columns)
    assert df.count() > 0
