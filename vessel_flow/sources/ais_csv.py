"""Daily AIS CSV scans.

Spark's CSV reader takes the first file's header for all files and reads the
rest by position, so a directory whose headers differ in order is silently
misread.  Here every file's header is read on the executors into a table that
is joined to the text lines by file name: each line is parsed by its own file's
header, in one scan of all files, however many headers there are.  Files that
lack a required column, or whose header cannot be read, are returned as a
reject table instead of failing the job (S5).  Lines that do not fit their
header or lack a vessel or a time are quarantined with their text, file and
reason; every line of an accepted file is either a row or in quarantine.
Lines are parsed one by one, so a value may not hold a line end.  Zero-length
files hold no split, so they add no rows and no reject.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import AIS_COLUMNS, OPTIONAL_COLUMNS, typed_ais
from ..params import DEFAULT, Params
from ..session import cut_lineage

HEADER_SCHEMA = "path string, header string, error string, source_file string"


def _opened(path: str):
    """An input stream through pyarrow's filesystem layer (local, HDFS, object
    stores; ``s3a`` is Hadoop's name for ``s3``)."""
    from pyarrow import fs as pafs
    f, p = pafs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)
    return f.open_input_stream(p)


def _first_line(path: str) -> str:
    head = b""
    with _opened(path) as s:
        while b"\n" not in head and (more := s.read(1 << 16)):
            head += more
    return head.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")


def _read_first_lines(it):
    """mapInPandas body: first line of each listed file."""
    for pdf in it:
        out = []
        for path, name in zip(pdf["path"], pdf["source_file"]):
            try:
                line = _first_line(path)
                out.append((path, line, None if line else "empty file", name))
            except Exception as e:  # unreadable file -> reject, not a failed job
                out.append((path, None, f"{type(e).__name__}: {e}", name))
        yield pd.DataFrame(out, columns=["path", "header", "error", "source_file"])


def file_headers(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """(path, header, error, source_file) for every file under ``path`` (a
    folder, or a list of files) matching ``glob``; ``source_file`` is the file's
    name as rows carry it.  Only file metadata is listed; the first bytes of
    each file are read on the executors."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
               .option("recursiveFileLookup", "true").load(path)
               .select("path", F.col("_metadata.file_path").alias("source_file")))
    return listing.mapInPandas(_read_first_lines, HEADER_SCHEMA)


def _text(spark: SparkSession, path: str | list[str], glob: str) -> DataFrame:
    """(line, source_file) of every file."""
    return (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
            .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file")))


def _headers_by_scan(text: DataFrame, required: list[str]) -> DataFrame:
    """Fallback for a file system that pyarrow does not know: Spark's own text
    reader finds the header of each file, the one line that names the required
    columns.  This reads the files once more, so it is only used there."""
    toks = F.transform(F.split(F.col("line"), ","), lambda t: F.trim(F.regexp_replace(t, '"', "")))
    cond = F.array_size(F.array_except(F.array(*[F.lit(c) for c in required]), toks)) == 0
    return text.where(cond).groupBy("source_file").agg(F.first("line").alias("found"))


@dataclass
class CsvScan:
    """One scan of daily files; every frame derives from ``lines``."""

    lines: DataFrame       # every data line of the accepted files: columns as text, source_file, malformed, line, reason
    rows: DataFrame        # lines without a reason: AIS_COLUMNS and optional ones as text, source_file
    quarantine: DataFrame  # the other lines: source_file, line, reason
    rejects: DataFrame     # files that could not be read: path, reason


def _fields(widths: list[int], line: str) -> Column:
    """struct(v: values in the file's order, bad: the line when it does not fit
    its header) of a line whose file's header has ``width`` columns.  Each line
    is parsed once, by the schema of its own width."""
    def case(n: int) -> Column:
        names = [f"c{i}" for i in range(n)]
        schema = ", ".join(f"{c} string" for c in names) + ", _malformed string"
        parsed = F.from_csv(F.col(line), F.lit(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
        return F.get(F.transform(F.array(parsed), lambda x: F.struct(
            F.array(*[x[c] for c in names]).alias("v"), x["_malformed"].isNotNull().alias("bad"))), F.lit(0))

    out = F.when(F.col("width") == widths[0], case(widths[0]))
    for n in widths[1:]:
        out = out.when(F.col("width") == n, case(n))
    return out


def read_ais_csv(spark: SparkSession, path: str | list[str], glob: str = "AIS_*.csv",
                 required: list[str] = AIS_COLUMNS, p: Params = DEFAULT) -> CsvScan:
    """Scan a directory (or year folder) of daily AIS CSVs, all columns as
    text; pick files by name with ``glob`` (S2, e.g. ``AIS_2024_03_*.csv``).

    The files' headers make a table (file, number of columns, where each column
    stands) that is joined to the text lines by file name, so any mixture of
    headers is one scan, and no list of files passes through the driver.  The
    table is broadcast if its bytes stay within ``p.broadcast_max_bytes``."""
    text = _text(spark, path, glob)
    heads = cut_lineage(file_headers(spark, path, glob))
    if heads.where("error is null or error like 'empty%'").isEmpty() and not heads.isEmpty():
        heads = cut_lineage(heads.join(_headers_by_scan(text, required), "source_file", "left").select(
            "path", F.coalesce("found", "header").alias("header"),
            F.when(F.col("found").isNull(), F.col("error")).alias("error"), "source_file"))
    cols = F.transform(F.split("header", ","), lambda c: F.trim(F.trim(c), F.lit('"')))
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), F.col("cols"))
    heads = heads.withColumn("cols", F.when(F.col("error").isNull(), cols)).withColumn(
        "reason", F.when(F.col("error").isNotNull(), F.col("error")).when(
            F.size(missing) > 0, F.concat(F.lit("missing columns "), F.array_join(missing, ", "), F.lit("; found "),
                                          F.array_join("cols", ", "))))
    keep = list(required) + [c for c in OPTIONAL_COLUMNS if c not in required]
    files = heads.where("reason is null").select(
        "source_file", "header", F.size("cols").alias("width"),
        F.array(*[F.array_position("cols", F.lit(c)).cast("int") for c in keep]).alias("at"))
    found = files.agg(F.collect_set("width"), F.sum(F.octet_length("source_file") + F.octet_length("header") + 128)).first()
    widths, size = sorted(found[0]) or [1], found[1] or 0  # the numbers of columns of all headers: a handful
    lines = (text.join(F.broadcast(files) if size <= p.broadcast_max_bytes else files, "source_file")
             .where("trim(line) <> '' and line <> header and line <> concat('\ufeff', header)")
             .select("source_file", "line", "at", _fields(widths, "line").alias("f")))
    lines = lines.select(*[F.when(F.col("at")[i] > 0, F.get("f.v", F.col("at")[i] - 1)).alias(c)
                           for i, c in enumerate(keep)], "source_file", F.col("f.bad").alias("malformed"), "line")
    typed = typed_ais(lines, extra=["source_file", "malformed", "line", *[F.col(c).alias(f"_{c}") for c in AIS_COLUMNS]])
    reason = (F.when(F.col("malformed"), "does not fit the header").when(F.col("MMSI").isNull(), "no vessel")
              .when(F.col("BaseDateTime").isNull(), "no time"))
    lines = typed.select(*[F.col(f"_{c}" if c in AIS_COLUMNS else c).alias(c) for c in keep],
                         "source_file", "malformed", "line", reason.alias("reason"))
    return CsvScan(lines, lines.where("reason is null").drop("malformed", "line", "reason"),
                   lines.where("reason is not null").select("source_file", "line", "reason"),
                   heads.where("reason is not null").select("path", "reason"))


def ingest_report(lines: DataFrame) -> DataFrame:
    """Per file: rows, rows that do not fit their header, and rows that the
    ingest drops for want of a vessel or a time (R-Q15)."""
    typed = typed_ais(lines, extra=["source_file", "malformed"])
    both = typed.select("source_file", "malformed", F.col("MMSI").isNull().alias("no_vessel"),
                        F.col("BaseDateTime").isNull().alias("no_time"))
    return both.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("malformed").alias("malformed"),
        F.count_if("no_vessel").alias("no_vessel"), F.count_if("no_time").alias("no_time"),
        F.count_if(F.col("no_vessel") | F.col("no_time")).alias("dropped"))


LINE_COLUMNS = ["archive", "member", "line_no", "header", "line", "error"]
ZIP_SCHEMA = "archive string, member string, line_no long, header string, line string, error string"
MEMBER_SCHEMA = "archive string, member string, place int, size long, error string"


def _seekable(path: str):
    """A file that is read by ranges, through pyarrow's filesystem layer."""
    from pyarrow import fs as pafs
    f, p = pafs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)
    return f.open_input_file(p)


def _members(it):
    """mapInPandas body: a row for every ``.csv`` member of each archive, from
    its central directory alone (the last bytes of the file), or one row with
    what went wrong."""
    import zipfile
    for pdf in it:
        out = []
        for path in pdf["path"]:
            try:
                with _seekable(path) as f, zipfile.ZipFile(f) as z:
                    infos = [(i, m) for i, m in enumerate(z.infolist()) if m.filename.endswith(".csv")]
                out += [(path, m.filename, i, m.compress_size, None) for i, m in infos] or [
                    (path, None, -1, 0, "No CSV found in zip")]
            except Exception as e:
                out.append((path, None, -1, 0, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["archive", "member", "place", "size", "error"])


def _member_lines(z, path: str, member):
    """Frames of the lines of one member, inflated piece by piece, and one row
    without a line at its end: ``error`` says what went wrong."""
    import io
    n, head, held = 0, None, []
    try:
        with z.open(member) as f:
            for line in io.TextIOWrapper(f, "utf-8-sig", newline="\n"):
                line = line.rstrip("\r\n")
                if head is None:
                    head = line
                elif line:
                    n += 1
                    held.append((path, member.filename, n, head, line, None))
                if len(held) >= 50_000:
                    yield pd.DataFrame(held, columns=LINE_COLUMNS)
                    held = []
        why = None if head else "empty file"
    except Exception as e:  # a broken member: the lines before the fault, and the fault
        why = f"{type(e).__name__}: {e}"
    yield pd.DataFrame([*held, (path, member.filename, n, head, None, why)], columns=LINE_COLUMNS)


def _inflate_members(it):
    """mapInPandas body on (archive, member, place): reads the byte ranges of
    the named members only."""
    import zipfile
    for pdf in it:
        for path, places in pdf.groupby("archive")["place"]:
            with _seekable(path) as f, zipfile.ZipFile(f) as z:
                infos = z.infolist()
                for i in places:
                    yield from _member_lines(z, path, infos[i])


def _inflate(it):
    """mapInPandas body on (path, content), for a file system that only Spark
    knows: the lines of every ``.csv`` member of a whole archive."""
    import io
    import zipfile
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.filename.endswith(".csv"):
                            yield from _member_lines(z, path, info)
            except Exception as e:
                yield pd.DataFrame([(path, None, 0, None, None, f"{type(e).__name__}: {e}")], columns=LINE_COLUMNS)


#: What pyarrow says of a file system that it cannot reach.
UNKNOWN_STORE = "Unrecognized filesystem|libhdfs|libjvm|Protocol not known|unknown scheme"


def zip_lines(spark: SparkSession, path: str, glob: str = "AIS_*.zip", member_bytes: int = 64 << 20) -> DataFrame:
    """Lines of all CSV members of the archives, and a row without a line at the
    end of each member (or for an archive without any).

    The archives' central directories make a table of members first.  Members
    are then dealt out by name, so that a task inflates about ``member_bytes``
    of compressed bytes: one archive of many members is read by many tasks, each
    by ranges, and no task holds an archive."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
              .option("recursiveFileLookup", "true").load(path))
    found = cut_lineage(listed.select("path").mapInPandas(_members, MEMBER_SCHEMA))
    members = found.where("error is null")
    size, count = members.agg(F.sum("size"), F.count(F.lit(1))).first()
    tasks = max(1, min(count, max(-(-(size or 0) // member_bytes), spark.sparkContext.defaultParallelism)))
    out = (members.repartition(tasks, "archive", "member").select("archive", "place")
           .mapInPandas(_inflate_members, ZIP_SCHEMA))
    unknown = F.col("error").rlike(UNKNOWN_STORE)
    faults = found.where(F.col("error").isNotNull())
    none = lambda t: F.lit(None).cast(t)
    out = out.unionByName(faults.where(~unknown).select(
        "archive", none("string").alias("member"), F.lit(0).cast("long").alias("line_no"),
        none("string").alias("header"), none("string").alias("line"), "error"))
    far = faults.where(unknown).select(F.col("archive").alias("path"))
    if not far.isEmpty():
        out = out.unionByName(listed.select("path", "content").join(far, "path", "left_semi").mapInPandas(_inflate, ZIP_SCHEMA))
    return out


def read_zipped_ais(spark: SparkSession, path: str, glob: str = "AIS_*.zip") -> tuple[DataFrame, DataFrame]:
    """Rows of every CSV member of daily zip archives (S11), as text like
    ``read_ais_csv``'s, and one status row per archive.

    Members are read once, by ranges (``zip_lines``): Python only inflates them
    to lines, which are saved in the shared folder; Spark parses the lines by
    their member's header and counts the status.  An archive counts as holding a
    CSV only if every member was read to its end and has the required columns."""
    lines = cut_lineage(zip_lines(spark, path, glob))
    cols = F.transform(F.split("header", ","), lambda c: F.trim(F.trim(c), F.lit('"')))
    ends = lines.where("line is null").withColumn("cols", cols)
    missing = F.array_except(F.array(*[F.lit(c) for c in AIS_COLUMNS]), F.col("cols"))
    why = F.coalesce("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing columns "), F.array_join(missing, ", "))))
    status = (ends.groupBy("archive").agg(
        F.count("member").cast("int").alias("csv_members"), F.sum("line_no").alias("lines"),
        F.array_join(F.array_sort(F.collect_list(F.when(why.isNotNull(), F.concat_ws(": ", "member", why)))), "; ")
        .alias("error"))
        .withColumn("error", F.when(F.col("error") != "", F.col("error")))
        .withColumn("day", F.to_date(F.regexp_extract("archive", r"AIS_(\d{4}_\d{2}_\d{2})", 1), "yyyy_MM_dd"))
        .withColumn("has_csv", F.col("error").isNull() & (F.col("csv_members") > 0)))
    keep = [*AIS_COLUMNS, *OPTIONAL_COLUMNS]
    found = lines.where("line is not null").withColumn("cols", cols)
    width = ends.agg(F.max(F.size("cols"))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    found = found.withColumn("f", F.from_csv("line", schema))
    values = F.array(*[F.col(f"f.c{i}") for i in range(width)])
    at = lambda c: F.array_position("cols", F.lit(c)).cast("int")
    rows = found.select("archive", "member", "cols", values.alias("v")).select(
        "archive", "member", *[F.when(at(c) > 0, F.try_element_at("v", F.greatest(at(c), F.lit(1)))).alias(c)
                               for c in keep])
    return rows, status
