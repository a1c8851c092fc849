"""Range slices of hot vessels: as many as the session has partitions or the
rows need, however small the chunks are."""

from vessel_flow.operators import ingest, split
from vessel_flow.plans.queries import PBURST, PSPLIT
from vessel_flow.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_small_chunks_do_not_add_slices():
    for rows in (6_000_000, 36_000_000):
        for p in (PSPLIT, PBURST):
            assert split.slice_count(rows, 200, p) == max(200, rows // p.slice_rows)
    big = PSPLIT.with_(chunk_rows=2_000_000)
    assert split.slice_count(36_000_000, 8, big) == 18  # a slice is never smaller than a chunk


def _first_round(spark, p, vessel):
    rows = ingest.ingest(fx.ais_from_events(fx.table(spark, SF, "events"), vessel=vessel))
    hot = split.hot_vessels(split.vessel_stats(rows), p)
    bag = []
    out = split.numbered(split.mark_hot(rows, hot).where("hot").drop("hot"), hot, p, bag)
    return out, bag[0]


def test_forced_split_runs_in_a_session_s_partitions(spark):
    out, sliced = _first_round(spark, PSPLIT.with_(hot_vessel_rows=0), "user")
    assert out.count() > 16 * 8 * 4
    assert sliced.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in out.groupBy(*split.CKEY).count().collect()]
    assert max(sizes) <= PSPLIT.chunk_rows


def test_every_round_of_a_forced_split_runs_in_a_session_s_partitions(spark):
    p = PSPLIT.with_(hot_vessel_rows=0)
    rows = ingest.ingest(fx.ais_from_events(fx.table(spark, SF, "events")))
    hot = split.hot_vessels(split.vessel_stats(rows), p)
    h = split.HotStages(split.mark_hot(rows, hot).where("hot").drop("hot"), hot, p)
    assert h.co2.count() > 0
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(h.persisted) == 5 and all(d.rdd.getNumPartitions() <= most for d in h.persisted)


def test_one_vessel_in_small_chunks_runs_in_a_session_s_partitions(spark):
    out, sliced = _first_round(spark, PBURST.with_(chunk_rows=20), "one")
    assert out.select("chunk").distinct().count() > 40
    assert sliced.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
