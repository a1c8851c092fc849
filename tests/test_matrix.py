"""Wide forms and period merge."""

from vessel_flow.operators import matrix


def test_union_wide_fills_missing_state_columns(spark):
    jan = spark.createDataFrame([(2024, 1, "A", 1.0, 2.0)], "year int, MMSI long, start_state string, total double, B double")
    feb = spark.createDataFrame([(2024, 2, "A", 3.0, 4.0)], "year int, MMSI long, start_state string, total double, C double")
    out = matrix.union_wide([jan, feb])
    got = sorted(tuple(r) for r in out.select("MMSI", "B", "C").collect())
    assert got == [(1, 2.0, 0.0), (2, 0.0, 4.0)]


def test_transfer_matrix_fills_gaps_and_sorts_columns(spark):
    t = spark.createDataFrame([(2024, "X", "B", 1.0), (2024, "Y", "A", 2.0)],
                              "year int, source_state string, dest_state string, amount double")
    m = matrix.transfer_matrix(t)
    assert m.columns == ["year", "source_state", "A", "B"]
    assert sorted(tuple(r) for r in m.collect()) == [(2024, "X", 0.0, 1.0), (2024, "Y", 2.0, 0.0)]


def test_merge_periods_sums_months(spark):
    f = spark.createDataFrame([(2024, 202401, "X", "B", 1.0), (2024, 202402, "X", "B", 2.5)],
                              "year int, period int, source_state string, dest_state string, amount double")
    assert [tuple(r) for r in matrix.merge_periods(f).collect()] == [(2024, "X", "B", 3.5)]
