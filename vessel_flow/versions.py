"""Tables whose partitions are replaced all at once.

A folder holds the runs that were written to it and a record of which run is
live for which period:

    <root>/<table>/run=<run>/<key>=<value>/...   rows, written once, never changed
    <root>/_versions/<n>.json                    the live run of every table and value

A run first writes all its tables.  Then ``commit`` puts one small record
beside the former ones, under the next number, by a rename that fails if the
number is taken.  Readers take the record with the largest number and read the
runs it names, with filters on partition columns.  So a run that dies half way
changes nothing, a reader sees the tables either all before or all after a run,
and one that began before the switch goes on with its own files until
``vacuum`` removes them, two versions later.

Two runs at a time: the second to commit reads the record of the first again
and adds its own values to it; if both replaced the same value of a table,
it fails with ``Conflict``.

The record has an entry for each period: a handful a year.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_versions"


class Conflict(RuntimeError):
    """Another run replaced the same period since this one began."""


class Files:
    """The few file operations of a commit, on whatever file system Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, *parts: str):
        out = self.jvm.org.apache.hadoop.fs.Path(str(parts[0]))
        for p in parts[1:]:
            out = self.jvm.org.apache.hadoop.fs.Path(out, p)
        return out

    def names(self, *parts: str) -> list[str]:
        at = self.path(self.root.toString(), *parts)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(self.root.toString(), *parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, text: str, *parts: str) -> bool:
        """A new file with all its bytes, or False if the name is taken."""
        target = self.path(self.root.toString(), *parts)
        draft = self.path(target.getParent().toString(), f".{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.jvm.java.lang.reflect.Array.newInstance(
            self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(draft, target, options)
            return True
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(self.root.toString(), *parts), True)


class Store:
    """The versioned tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names(LOG) if (m := re.fullmatch(r"(\d+)\.json", n)))

    def record(self, number: int | None = None) -> dict:
        """A version's record, the present one by default: number, tables ->
        {key, live: {value: run}}."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return {"number": 0, "tables": {}}
            number = numbers[-1]
        return json.loads(self.files.read(LOG, f"{number}.json"))

    def folder(self, table: str) -> str:
        return f"{self.root}/{table}" if table else self.root

    def read(self, table: str = "", schema: str | None = None, number: int | None = None) -> DataFrame | None:
        """The live rows of a table; None if it was never written."""
        entry = self.record(number)["tables"].get(table)
        if entry is None:
            return None
        by_run: dict[str, list[int]] = {}
        for value, run in entry["live"].items():
            by_run.setdefault(run, []).append(int(value))
        rows = self._of_runs(table, sorted(by_run), schema)
        live = F.lit(False)
        for run, values in sorted(by_run.items()):
            live = live | ((F.col("run") == run) & F.col(entry["key"]).isin(sorted(values)))
        return rows.where(live).drop("run")

    def _of_runs(self, table: str, runs: list[str], schema: str | None) -> DataFrame:
        """Rows and ``run`` of the named runs, in the order of the given schema."""
        folder = self.folder(table)
        reader = self.spark.read.option("basePath", folder)
        if schema is None:  # a run without any row has no file that tells its columns
            full = [r for r in runs if any("=" in n for n in self.files.names(*([table] if table else []), f"run={r}"))]
            return reader.option("mergeSchema", True).parquet(*[f"{folder}/run={r}" for r in full or runs])
        wanted = self.spark.createDataFrame([], schema).schema.add("run", "string")
        return reader.schema(wanted).parquet(*[f"{folder}/run={r}" for r in runs]).select(*wanted.names)

    def begin(self) -> Run:
        return Run(self)

    def vacuum(self, keep: int = 2) -> None:
        """Removes runs and records that none of the last ``keep`` versions
        names.  Not for use while another run is being written."""
        numbers = self.numbers()
        records = [self.record(n) for n in numbers[-keep:]]
        for table in {t for r in records for t in r["tables"]}:
            live = {run for r in records for run in r["tables"].get(table, {"live": {}})["live"].values()}
            for name in self.files.names(*([table] if table else [])):
                if name.startswith("run=") and name[4:] not in live:
                    self.files.delete(*([table] if table else []), name)
        for n in numbers[:-keep]:
            self.files.delete(LOG, f"{n}.json")


class Run:
    """One run's writes; nothing of it is seen before ``commit``."""

    def __init__(self, store: Store):
        self.store, self.name = store, f"r{uuid.uuid4().hex}"
        self.base, self.tables = store.record(), {}

    def write(self, df: DataFrame, values: list[int], table: str = "", key: str = "period",
              parts: list[str] | None = None) -> None:
        """Rows of ``df``, partitioned by ``parts`` (default: ``key``), in place
        of all rows of ``values``, also of those that have no row any more.

        Rows are dealt by partition and a salt, so that a period is written by
        several tasks with a file each, and not by every task of the plan."""
        parts = parts or [key]
        held = self.base["tables"].get(table)
        if held and held["key"] != key:
            raise ValueError(f"{self.store.folder(table)} is replaced by {held['key']}, not by {key}")
        old = [n for n in self.store.files.names(*([table] if table else [])) if "=" in n and not n.startswith("run=")]
        if not held and old:
            raise ValueError(f"{self.store.folder(table)} holds partitions without a version record: {old[:3]}")
        spark = df.sparkSession
        salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(values)))
        plain = [F.col(c) for c, t in df.dtypes if c not in parts and "<" not in t]
        (df.repartition(*parts, F.pmod(F.xxhash64(*plain), F.lit(salts)))
         .write.partitionBy(*parts).parquet(f"{self.store.folder(table)}/run={self.name}"))
        entry = self.tables.setdefault(table, {"key": key, "values": []})
        entry["values"] += [int(v) for v in values]

    def read(self, table: str = "", schema: str | None = None) -> DataFrame:
        """What this run wrote, before the commit."""
        return self.store._of_runs(table, [self.name], schema).drop("run")

    def _merged(self, now: dict) -> dict:
        tables = {t: {"key": e["key"], "live": dict(e["live"])} for t, e in now["tables"].items()}
        for table, mine in self.tables.items():
            before = self.base["tables"].get(table, {"live": {}})["live"]
            live = tables.setdefault(table, {"key": mine["key"], "live": {}})["live"]
            for v in map(str, mine["values"]):
                if live.get(v) != before.get(v):
                    raise Conflict(f"{table or self.store.root}: {mine['key']} {v} was replaced by another run")
                live[v] = self.name
        return {"number": now["number"] + 1, "tables": tables}

    def commit(self) -> int:
        """Makes all writes of the run the live ones; the new version's number."""
        while True:
            new = self._merged(self.store.record())
            if self.store.files.put(json.dumps(new), LOG, f"{new['number']}.json"):
                return new["number"]
