"""New daily AIS files -> typed, filtered rows in a period-partitioned table.

A ``binaryFile`` stream lists new files only (its checkpoint records which
files were processed, so a re-run skips them, as the reference's downloader
skips files already present).  Each micro-batch reads its files with the
header-checked CSV reader and overwrites its own ``batch`` partitions, so a
retried micro-batch replaces, rather than duplicates, its output.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ingest
from ..params import DEFAULT, Params
from ..session import checkpoint_dir
from ..sources.ais_csv import read_ais_csv


LISTING_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incremental_ingest(spark: SparkSession, src: str, dest: str, name: str = "ais-ingest",
                       glob: str = "AIS_*.csv", files_per_batch: int = 64,
                       p: Params = DEFAULT, checkpoint: str | None = None) -> dict:
    """Process the files under ``src`` not seen before; returns counters.

    ``dest`` gets the ingested rows partitioned by (period, batch);
    ``dest + "_rejects"`` the files rejected by the header check, and
    ``dest + "_quarantine"`` the lines that gave no row.  The
    stream's checkpoint lives in the shared ``spark.checkpoint.dir`` unless
    ``checkpoint`` names another shared folder."""
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    files = (spark.readStream.format("binaryFile").schema(LISTING_SCHEMA).option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
             .load(src).select("path"))
    done = {"batches": 0, "files": 0}
    # batch numbers start again under a new checkpoint: name the stream by its checkpoint
    stream = f"{name}-{zlib.crc32(ckpt.encode()):08x}"

    def run_batch(batch: DataFrame, epoch: int) -> None:
        # the file names of one micro-batch: metadata bounded by maxFilesPerTrigger
        paths = [r["path"] for r in batch.collect()]
        if not paths:
            return
        scan = read_ais_csv(spark, paths, glob, p=p)
        label = F.lit(f"{stream}-{epoch}")
        (ingest(scan.rows, p).withColumn("batch", label).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("period", "batch").parquet(dest))
        for out, name in ((scan.rejects, "rejects"), (scan.quarantine, "quarantine")):
            (out.withColumn("batch", label).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{dest}_{name}"))
        done["batches"] += 1
        done["files"] += len(paths)

    q = (files.writeStream.foreachBatch(run_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return done
