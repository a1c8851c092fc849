"""Legacy ARC archives, converted to WARC.

``write_arc`` makes ARC archives of both header versions from pages (the
legacy side), ``index_arc`` parses them, ``convert`` rewrites each as a WARC
archive with synthesised identifiers, timestamps, types and digests, and
``read_warc`` reads those back.  Of records with equal payloads the one with
the smallest page id becomes a response, the others revisit it.

Each attempt of a task writes archives of at most ``roll_bytes`` to the shared
folder under names of its own, and the table of paths that Spark keeps of the
successful attempt says which ones count; nothing is moved or deleted.  Index,
conversion and reading deal the archives out over as many tasks as there are
archives (``most_tasks`` at most), whatever their paths weigh.  Archives are
streamed record by record.  The roles are found by one aggregate and a join
over narrow index rows, in which AQE splits a payload with many records.

Archives of others are read too: plain or compressed; headers that end in CRLF
or LF, with any bytes, and fields with or without a blank behind the colon; a
record that is no HTTP response (``dns:`` and the like) becomes a ``resource``
with its own content type; one without a length or a page id takes its length
from its block and its identifier from URL, date, digest and place.

Defined cases: a null html is an empty payload, a null url is ``about:blank``;
null page ids come after all others and, like equal smallest ids, are each a
response if their group has no smaller id; a very long page is one record of
its archive; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

# fixed values of the two formats
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Params:
    roll_bytes: int = 32 << 20
    date: str = "20200102030405"
    address: str = "0.0.0.0"
    level: int = 1
    most_tasks: int = 20_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page id, so that it can be read back."""
    n = 0 if page_id is None else page_id & (1 << 64) - 1
    high = (0x70616765 << 32) | (n >> 48) << 16 | 0x8000 | (n >> 36) & 0xFFF
    low = 0x8000000000000000 | (n & (1 << 36) - 1) << 26 | (page_id is not None)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def foreign_id(*parts: str) -> str:
    """A version 5 UUID for a record that names no page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    high, low = n >> 64, n & (1 << 64) - 1
    if high >> 32 != 0x70616765 or high >> 12 & 15 != 8:  # an identifier of another kind
        return None
    page = (high >> 16 & 0xFFFF) << 48 | (high & 0xFFF) << 36 | low >> 26 & (1 << 36) - 1
    return (page - (1 << 64) if page >> 63 else page) if low & 1 else None


class Sink:
    """One archive, under a name that no other attempt uses."""

    def __init__(self, path: str, level: int):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.level, self.size = level, 0
        self.out = self.fs.open_output_stream(self.path, compression=None)

    def add(self, record: bytes) -> None:
        self.out.write(gzip.compress(record, self.level, mtime=0))  # a member for each record
        self.size += len(record)

    def close(self) -> None:
        self.out.close()


def opened(path: str) -> BinaryIO:
    store, name = fs.FileSystem.from_uri(path)
    stream = store.open_input_file(name)
    packed = stream.read(2) == b"\x1f\x8b"
    stream.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream) if packed else stream, 1 << 20)


def dealt(paths: DataFrame, most: int) -> DataFrame:
    """``paths`` spread over a task for each; a count that is given stays as it is."""
    return paths.repartition(max(1, min(paths.count(), most)))


def arc_head(version: int, name: str, params: Params) -> bytes:
    body = f"{version} 0 Archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = ["text/plain", "200", "-", "-", "0", name] if version == 2 else ["text/plain"]
    return f"filedesc://{name} {params.address} {params.date} {' '.join(tail)} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, payload: bytes,
               params: Params) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n"
    block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    tail = ["text/html", "200", digest(payload), "-", str(offset), name] if version == 2 else ["text/html"]
    return f"{uri} {params.address} {params.date} {' '.join(tail)} {len(block)}\n".encode() + block + b"\n"


_END_OF_HEAD = re.compile(rb"\r?\n\r?\n")


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header block with its empty line, its fields (names in lower case), and
    the payload.  A block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    m = _END_OF_HEAD.search(block)
    end = m.end() if m else len(block)
    fields = {}
    for line in block[:end].decode("latin-1").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return block[:end], fields, block[end:]


def page_id_of(http: dict[str, str]) -> int | None:
    value = http.get("x-page-id", "")
    return int(value) if re.fullmatch(r"-?[0-9]{1,19}", value) else None


def iso_date(d: str) -> str:
    d += "00000101000000"[len(d):]  # older archives leave out the time
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_arc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record after the first, by the version
    that the first record declares."""
    def block(fields: dict[str, str]) -> bytes:
        size = int(fields["Archive-length"])
        body = stream.read(size)
        if len(body) != size:
            raise ValueError(f"record of {fields['URL']} is shorter than the {size} bytes it declares")
        return body

    first = stream.readline().decode("latin-1").rstrip("\r\n")
    if not first.startswith("filedesc://"):
        raise ValueError("no ARC version block")
    body = block({"URL": first.split(" ")[0], "Archive-length": first.rsplit(" ", 1)[1]}).decode("latin-1").split("\n")
    version = int(body[0].split(" ")[0])
    if version not in ARC_FIELDS or body[1].split() != ARC_FIELDS[version]:
        raise ValueError(f"unknown ARC header {body[:2]}")
    names = ARC_FIELDS[version]
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("latin-1").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"header line with {len(values)} of {len(names)} fields")
        fields = dict(zip(names, values))
        yield fields, block(fields)


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def to_warc(arc: dict[str, str], block: bytes, kind: str, refers_to: int | None, place: str = "") -> bytes:
    """The WARC record equivalent to an ARC one that stands at ``place``."""
    head, http, payload = http_parts(block)
    page = page_id_of(http)
    kind = kind if head else "resource"
    stored = head if kind == "revisit" else block
    own = record_id(page) if page is not None else foreign_id(arc["URL"], arc["Archive-date"], digest(payload), place)
    fields = [("WARC-Record-ID", own), ("WARC-Date", iso_date(arc["Archive-date"])),
              ("WARC-Target-URI", arc["URL"]), ("WARC-IP-Address", arc["IP-address"]),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(stored)}"),
              ("Content-Type", "application/http; msgtype=response" if head else arc["Content-type"]),
              ("X-Payload-Length", str(len(payload)))]  # a revisit stores no payload
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return warc_record(kind, fields, stored)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(":")
            fields[name] = value.strip()
        block = stream.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("truncated WARC record")
        yield fields, block


_INDEX = "path string, ord long, page_id long, payload_bytes long, payload_digest string"
_RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write_arc(pages: DataFrame, folder: str, params: Params = Params()) -> DataFrame:
    """Archives of (page_id, url, html) rows below ``folder``; their paths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, paths, sink = TaskContext.get().partitionId(), 0, [], None
        version = 1 + part % 2
        for b in batches:
            for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if sink is None:
                    name = f"p{part:06d}-{n:05d}-{uuid.uuid4().hex}.arc.gz"
                    paths.append(f"{folder}/{name}")
                    sink = Sink(paths[-1], params.level)
                    sink.add(arc_head(version, name, params))
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                sink.add(arc_record(version, name, sink.size, page, url, payload, params))
                if sink.size >= params.roll_bytes:
                    sink.close()
                    sink, n = None, n + 1
        if sink:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])
    return common.stored(pages.select("page_id", "url", "html").mapInArrow(run, "path string"), "arc-paths")


def index_arc(paths: DataFrame, params: Params = Params()) -> DataFrame:
    """One narrow row for each record of the archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with opened(path) as stream:
                    for k, (_, block) in enumerate(parse_arc(stream)):
                        _, http, payload = http_parts(block)
                        rows.append((path, k, page_id_of(http), len(payload), digest(payload)))
                if rows:
                    names = [c.split()[0] for c in _INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if i != 2 else pa.array(c, pa.int64())
                                                      for i, c in enumerate(zip(*rows))], names)
    return dealt(paths, params.most_tasks).mapInArrow(run, _INDEX)


def roles(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Record type and refers_to of each index row."""
    same = ["payload_digest", "payload_bytes"]
    groups = (index.where(F.col("payload_bytes") >= least_bytes).groupBy(*same)
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"))
    first = F.col("first").isNull() | F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return (index.join(groups, same, "left")
            .select("path", "ord", F.when(first, "response").otherwise("revisit").alias("record_type"),
                    F.when(~first, F.col("first")).alias("refers_to")))


def convert(kinds: DataFrame, folder: str, params: Params = Params()) -> DataFrame:
    """A WARC archive below ``folder`` for each ARC archive; their paths.  A
    group is the narrow rows of one archive, which ``roll_bytes`` bounds; the
    groups are dealt over several partitions for each archive, so that few meet."""
    def run(table: pa.Table) -> pa.Table:
        source = table.column("path")[0].as_py()
        kind = dict(zip(table.column("ord").to_pylist(),
                        zip(table.column("record_type").to_pylist(), table.column("refers_to").to_pylist())))
        stem = source.rpartition("/")[2].removesuffix(".gz").removesuffix(".arc")
        path = f"{folder}/{stem}-{uuid.uuid4().hex}.warc.gz"
        sink = Sink(path, params.level)
        sink.add(warc_record("warcinfo", [
            ("WARC-Record-ID", record_id(None)),
            ("WARC-Date", iso_date(params.date)),
            ("WARC-Filename", path.rpartition("/")[2]), ("Content-Type", "application/warc-fields")],
            f"format: WARC File Format 1.1\r\nconverted-from: {source.rpartition('/')[2]}\r\n".encode()))
        with opened(source) as stream:
            for k, (arc, block) in enumerate(parse_arc(stream)):
                sink.add(to_warc(arc, block, *kind[k], place=f"{source} {k}"))
        sink.close()
        return pa.table({"path": [path]})
    n = max(1, min(4 * kinds.select("path").distinct().count(), params.most_tasks))
    return common.stored(kinds.repartition(n, "path").groupBy("path").applyInArrow(run, "path string"), "warc-paths")


def read_warc(paths: DataFrame, params: Params = Params()) -> DataFrame:
    """One row for each response, resource or revisit of the archives; digests
    are checked where the payload is stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with opened(path) as stream:
                    for warc, block in parse_warc(stream):
                        if warc["WARC-Type"] not in ("response", "resource", "revisit"):
                            continue
                        _, http, payload = http_parts(block)
                        own = warc["WARC-Type"] != "revisit"
                        given = warc.get("WARC-Payload-Digest", f"sha1:{digest(payload)}").removeprefix("sha1:")
                        if own and digest(payload) != given:
                            raise ValueError(f"payload of {warc['WARC-Target-URI']} in {path} has another digest")
                        refers = page_of(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None
                        rows.append((page_of(warc["WARC-Record-ID"]), warc["WARC-Target-URI"],
                                     len(payload) if own else int(warc.get("X-Payload-Length") or http["content-length"]),
                                     given, warc["WARC-Type"], refers))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     [c.split()[0] for c in _RESULT.split(", ")])
    return dealt(paths, params.most_tasks).mapInArrow(run, _RESULT)


def round_trip(pages: DataFrame, params: Params = Params(), least_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC archives read back."""
    folder = common.scratch(pages.sparkSession, "archives")
    index = common.stored(index_arc(write_arc(pages, f"{folder}/arc", params), params), "arc-index")
    return read_warc(convert(roles(index, least_bytes), f"{folder}/warc", params), params)
