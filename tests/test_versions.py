"""Versioned tables: what a reader sees while periods are replaced."""

import os

import pytest
from pyspark.sql import functions as F

from vessel_flow import sinks, versions

SCHEMA = "period int, amount double"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def seen(df):
    return sorted(map(tuple, df.collect()))


def test_named_periods_are_replaced_also_by_nothing(spark, scratch):
    at = f"{scratch}/t"
    sinks.replace_periods(rows(spark, (1, 1.0), (2, 2.0), (3, 3.0)), at)
    sinks.replace_periods(rows(spark, (2, 20.0), (2, 21.0)), at, [2, 3])
    assert seen(sinks.stored(spark, at, SCHEMA)) == [(1, 1.0), (2, 20.0), (2, 21.0)]
    sinks.replace_periods(rows(spark), at, [1, 2])
    assert seen(sinks.stored(spark, at, SCHEMA)) == []
    assert seen(sinks.stored(spark, f"{scratch}/never", SCHEMA)) == []


def test_a_run_that_dies_half_way_changes_nothing(spark, scratch):
    store = versions.Store(spark, f"{scratch}/out")
    run = store.begin()
    run.write(rows(spark, (1, 1.0)), [1], "a")
    run.write(rows(spark, (1, 5.0)), [1], "b")
    run.commit()
    broken = store.begin()
    broken.write(rows(spark, (1, 2.0)), [1], "a")

    def fail(it):
        yield from it
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        broken.write(rows(spark, (1, 6.0)).mapInPandas(fail, SCHEMA), [1], "b")
    assert seen(store.read("a", SCHEMA)) == [(1, 1.0)] and seen(store.read("b", SCHEMA)) == [(1, 5.0)]
    assert seen(sinks.stored(spark, f"{scratch}/out/a", SCHEMA)) == [(1, 1.0)]
    again = store.begin()
    again.write(rows(spark, (1, 2.0)), [1], "a")
    again.write(rows(spark, (1, 6.0)), [1], "b")
    again.commit()
    assert seen(store.read("a", SCHEMA)) == [(1, 2.0)] and seen(store.read("b", SCHEMA)) == [(1, 6.0)]
    store.vacuum(keep=1)  # what the broken run left goes, too
    assert len([n for n in os.listdir(f"{scratch}/out/a") if n.startswith("run=")]) == 1


def test_a_reader_keeps_its_version_until_vacuum(spark, scratch):
    at = f"{scratch}/t"
    sinks.replace_periods(rows(spark, (1, 1.0)), at)
    old = sinks.stored(spark, at, SCHEMA)
    sinks.replace_periods(rows(spark, (1, 2.0)), at)
    assert seen(old) == [(1, 1.0)] and seen(sinks.stored(spark, at, SCHEMA)) == [(1, 2.0)]
    for k in range(3):
        sinks.replace_periods(rows(spark, (1, 3.0 + k)), at)
    store = versions.Store(spark, at)
    assert len(store.numbers()) == 2 and len([n for n in os.listdir(at) if n.startswith("run=")]) == 2


def test_two_runs_at_a_time(spark, scratch):
    store = versions.Store(spark, f"{scratch}/t")
    one, two, three = store.begin(), store.begin(), store.begin()
    one.write(rows(spark, (1, 1.0)), [1])
    two.write(rows(spark, (2, 2.0)), [2])
    three.write(rows(spark, (1, 9.0)), [1])
    assert (one.commit(), two.commit()) == (1, 2)  # another period: both stay
    with pytest.raises(versions.Conflict):
        three.commit()
    assert seen(store.read("", SCHEMA)) == [(1, 1.0), (2, 2.0)]


def test_a_taken_number_is_not_overwritten(spark, scratch):
    files = versions.Files(spark, scratch)
    assert files.put("a", "_versions", "1.json") and not files.put("b", "_versions", "1.json")
    assert files.read("_versions", "1.json") == "a"
    assert [n for n in files.names("_versions") if not n.endswith(".crc")] == ["1.json"]


def test_only_live_partitions_are_read(spark, scratch):
    at = f"{scratch}/t"
    sinks.replace_periods(rows(spark, *[(k, 1.0 * k) for k in range(1, 6)]), at)
    sinks.replace_periods(rows(spark, (2, 20.0)), at, [2])
    df = sinks.stored(spark, at, SCHEMA).where("period in (2, 3)")
    assert seen(df) == [(2, 20.0), (3, 3.0)]
    assert len(df.inputFiles()) > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan


def test_foreign_partitions_are_not_lost(spark, scratch):
    rows(spark, (1, 1.0)).write.partitionBy("period").parquet(f"{scratch}/t")
    assert seen(sinks.stored(spark, f"{scratch}/t", "amount double, period int")) == [(1.0, 1)]
    with pytest.raises(ValueError, match="without a version record"):
        sinks.replace_periods(rows(spark, (1, 2.0)), f"{scratch}/t")


def test_periods_without_a_schema(spark, scratch):
    from vessel_flow.sources.dimensions import read_period_outputs
    at = f"{scratch}/t"
    sinks.replace_periods(rows(spark, (1, 1.0)), at)
    sinks.replace_periods(rows(spark, (2, 2.0)).withColumn("more", F.lit("x")), at)
    assert sorted((r.period, r.amount, r.more) for r in read_period_outputs(spark, at).collect()) == [(1, 1.0, None), (2, 2.0, "x")]


def test_a_write_without_named_periods_computes_its_rows_once(spark, scratch):
    from pyspark.sql import functions as F

    from vessel_flow import sinks
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return float(x)

    rows = spark.range(300).select(F.lit(2024).alias("year"), (F.col("id") % 3).cast("int").alias("period"),
                                   F.lit("A").alias("source_state"), F.lit("B").alias("dest_state"), told("id").alias("amount"))
    sums = rows.groupBy("year", "period", "source_state", "dest_state").agg(F.sum("amount").alias("amount")).where("amount > 0")
    sinks.write_period_sums(sums, f"{scratch}/sums")
    assert {r["period"]: r["amount"] for r in sinks.stored(spark, f"{scratch}/sums", sinks.FLOW_SCHEMA).collect()} == {
        k: float(sum(range(k, 300, 3))) for k in range(3)}
    assert seen.value == 300
