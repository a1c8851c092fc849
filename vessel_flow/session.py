"""Session helpers.

The library never creates a session behind the user's back: every operator
takes DataFrames.  ``get_spark`` is a convenience for scripts and tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "vessel_flow") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A scratch folder is taken only when the setting is unset and Spark runs
    in local mode (tests); on a cluster an unset setting is an error, since a
    machine-local folder would not survive the loss of an executor."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="vf-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint into ``spark.checkpoint.dir`` (never a local one):
    the plan below is truncated and the data survives executor loss.  The
    result keeps the partitioning and sort order of ``df``."""
    try:
        checkpoint_dir(df.sparkSession)
    except Exception as e:  # Spark Connect has no SparkContext: the server's setting applies
        if "sparkContext" not in str(e) and "JVM_ATTRIBUTE_NOT_SUPPORTED" not in str(e):
            raise
    return df.checkpoint(eager=True)
