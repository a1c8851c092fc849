"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vessel_flow.session import checkpoint_dir, cut_lineage

__all__ = ["read", "scratch", "stored", "cut_lineage", "row_key", "text_or_empty"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{_workspace.get() or checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Makes a finished write drop the shuffle files that led to it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.  This cuts
    the lineage, and lets later steps read single columns of it.  The shuffle
    files of the step go at its end: nothing reads them any more."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of ``stored`` that nothing reads any more."""
    _delete(df.sparkSession, df._folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """All folders that operators make inside are removed at the end.  Results
    must be written elsewhere by then."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
    token = _workspace.set(folder)
    try:
        yield
    finally:
        _workspace.reset(token)
        _delete(spark, folder)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit key of a row's content: rows with equal id and text share it."""
    return F.xxhash64(doc_id, text)
