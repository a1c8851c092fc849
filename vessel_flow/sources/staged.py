"""A trajectory kept in buckets by vessel.

``write_staged`` deals the rows out by vessel once and keeps that layout: each
period has one file for each bucket, sorted by vessel and time.  Who reads it
back through ``read_staged`` gets the partitioning from the files, so that the
windows and the route sums of a re-entry need no exchange of track rows.

Spark learns of buckets from its catalog only; the number of buckets is
therefore kept in a small file beside the rows, and each session that reads the
folder declares it as an external table.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..versions import Files

LAYOUT = "_layout.json"
SORT = ["MMSI", "seq"]


def write_staged(traj: DataFrame, folder: str, buckets: int) -> None:
    """Writes ``traj`` (with ``period``, ``MMSI`` and ``seq``) to a new folder."""
    spark = traj.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    columns = [c for c in traj.columns if c != "period"]
    # the same hash as the buckets', so that a task holds one bucket and writes one file a period
    dealt = traj.select(*columns, "period").repartition(buckets, F.col("MMSI")).sortWithinPartitions("period", *SORT)
    (dealt.write.partitionBy("period").bucketBy(buckets, "MMSI").sortBy(*SORT)
     .option("path", folder).format("parquet").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields]
    Files(spark, folder).put(json.dumps({"buckets": buckets, "fields": fields}), LAYOUT)


def read_staged(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a folder of ``write_staged``, partitioned by vessel."""
    layout = json.loads(Files(spark, folder).read(LAYOUT))
    name = f"staged_{zlib.crc32(folder.encode()):08x}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = folder.replace("'", "\\'")
    spark.sql(f"""CREATE TABLE {name} ({', '.join(layout['fields'])}) USING parquet PARTITIONED BY (period)
        CLUSTERED BY (MMSI) SORTED BY ({', '.join(SORT)}) INTO {layout['buckets']} BUCKETS LOCATION '{where}'""")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)
