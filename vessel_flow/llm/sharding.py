"""Consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of equal cells.  Every shard owns
``vnodes`` points; a cell belongs to the shard of the next point clockwise.
No shard takes more than ``(1 + slack)`` times the mean load: what overflows a
full shard continues clockwise to the next point whose shard has room.

Only the byte totals of the cells reach the driver (at most ``cells`` rows,
whatever the input).  There the overflow is resolved into pieces
``(cell, from byte, to byte, shard)``, again bounded by cells and points, and
broadcast; rows find their piece by their byte position inside their cell.
A row lies where its middle byte falls, so a shard's load differs from its
bound by less than one row for each piece; a cell with a single row is never
cut, and its shard is charged with the whole of it.

Defined cases: a null text has size 16 and checksum 0; null and repeated ids
are placed like any other row; rows that agree in id, size and checksum are
counted first, placed as a group and expanded in runs of bounded length, so
that a hot row is no hot group; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

OPEN_END = 1 << 62
#: Most copies of a row that are expanded at once.
RUN = 10_000


@dataclass(frozen=True)
class Ring:
    shards: int
    vnodes: int = 200
    cells: int = 1 << 16
    seed: int = 0

    def points(self) -> list[tuple[int, int]]:
        """(cell, shard) of every point in ring order; one point a cell."""
        at: dict[int, tuple[int, int]] = {}
        for s in range(self.shards):
            for v in range(self.vnodes):
                h = xxhash.xxh64_intdigest(f"{s}:{v}", self.seed)
                cell, rank = h % self.cells, h
                if cell not in at or rank < at[cell][0]:
                    at[cell] = (rank, s)
        return [(c, at[c][1]) for c in sorted(at)]

    def first_point(self, points: list[tuple[int, int]]) -> list[int]:
        """For every cell the index of the next point clockwise."""
        out, k = [], 0
        for c in range(self.cells):
            while k < len(points) and points[k][0] < c:
                k += 1
            out.append(k % len(points))
        return out

    def cell_of(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key, F.lit("ring")), F.lit(self.cells)).cast("int")


def resolve(ring: Ring, loads: dict[int, int], slack: float,
            single: frozenset[int] = frozenset()) -> list[tuple[int, int, int, int]]:
    """Pieces (cell, lo, hi, shard) covering the load of every cell; the last
    piece of a cell is open-ended.  Cells in ``single`` stay whole."""
    points = ring.points()
    first = ring.first_point(points)
    total = sum(loads.values())
    capacity = -(-int(total * (1 + slack) + 1) // ring.shards)
    room = [capacity] * ring.shards
    of_shard: dict[int, list[int]] = {}
    for k, (_, s) in enumerate(points):
        of_shard.setdefault(s, []).append(k)
    ahead = list(range(len(points) + 1))  # points of full shards lead to the next one

    def with_room(k: int) -> int:
        root = k
        while ahead[root % len(points)] != root % len(points):
            root = ahead[root % len(points)]
        root %= len(points)
        while ahead[k % len(points)] != k % len(points):
            ahead[k % len(points)], k = root, ahead[k % len(points)]
        return root

    def charge(cell: int, lo: int, hi: int, s: int) -> None:
        pieces.append((cell, lo, hi, s))
        room[s] -= hi - lo
        if room[s] <= 0 and any(x > 0 for x in room):
            for p in of_shard[s]:
                ahead[p] = (p + 1) % len(points)

    def put(cell: int, lo: int, hi: int, k: int) -> int:
        s = points[k][1]
        take = min(hi - lo, max(room[s], 0))
        if take:
            charge(cell, lo, lo + take, s)
        return lo + take

    def put_whole(cell: int, load: int, k: int) -> None:
        """Clockwise to the first shard that has room for it, else to
        the one with most room."""
        for _ in points:
            k = with_room(k)
            if load <= room[points[k][1]]:
                return charge(cell, 0, load, points[k][1])
            k = (k + 1) % len(points)
        charge(cell, 0, load, max(range(ring.shards), key=room.__getitem__))

    pieces: list[tuple[int, int, int, int]] = []
    over = []
    for cell in sorted(single, key=lambda c: (-loads[c], c)):  # the largest first, small ones even out
        put_whole(cell, loads[cell], first[cell])
    for cell in sorted(set(loads) - single):
        at = put(cell, 0, loads[cell], first[cell])
        if at < loads[cell]:
            over.append((cell, at, loads[cell], first[cell]))
    for cell, lo, hi, k in over:
        while lo < hi:
            k = with_room(k)
            lo = put(cell, lo, hi, k)
    pieces.sort()
    return [(c, lo, OPEN_END if i + 1 == len(pieces) or pieces[i + 1][0] != c else hi, s)
            for i, (c, lo, hi, s) in enumerate(pieces)]


def assign(docs: DataFrame, ring: Ring, slack: float = 0.001, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: ``id_col``, size, text_crc32, shard, slot,
    cell.  Loads are bytes: UTF-8 bytes of the text plus 16 a row."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("crc"))
    rows = rows.withColumn("cell", ring.cell_of(F.col("id"), F.col("crc")))
    rows = common.cut_lineage(rows.groupBy("cell", "id", "size", "crc").agg(F.count(F.lit(1)).alias("copies")))

    totals = rows.groupBy("cell").agg(F.sum(F.col("size") * F.col("copies")).alias("load"),
                                      F.sum("copies").alias("rows")).collect()  # at most ring.cells rows
    pieces = resolve(ring, {r["cell"]: r["load"] for r in totals}, slack,
                     frozenset(r["cell"] for r in totals if r["rows"] == 1))
    frame = pd.DataFrame([(c, i, lo, hi, s) for i, (c, lo, hi, s) in enumerate(pieces)],
                         columns=["cell", "piece", "lo", "hi", "shard"])
    table = F.broadcast(docs.sparkSession.createDataFrame(
        frame, "cell int, piece int, lo long, hi long, shard int"))  # at most cells + points rows

    in_cell = Window.partitionBy("cell").orderBy(F.xxhash64("id", "crc"), "id", "size", "crc")
    # the middle of copy k lies at before + k * size + size div 2, so a piece holds copies first to last - 1
    copies_below = lambda end: F.greatest(F.lit(0).cast("long"), F.least(
        F.col("copies"), F.expr(f"({end} - before - size div 2 + size - 1) div size")))
    placed = (rows
              .withColumn("before", F.sum(F.col("size") * F.col("copies")).over(in_cell) - F.col("size") * F.col("copies"))
              .join(table, "cell")
              .withColumn("n", copies_below("hi") - copies_below("lo")).where("n > 0"))
    in_piece = Window.partitionBy("cell", "piece").orderBy("before")
    placed = common.cut_lineage(placed.select("id", "size", "crc", "cell", "piece", "shard", "n", (
        F.sum("n").over(in_piece) - F.col("n")).alias("rank")))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = (placed.groupBy("shard", "piece").agg(F.sum("n").alias("count"))
            .select("piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    placed = placed.join(F.broadcast(base), "piece")  # as many rows as pieces at most
    # a group of many copies is dealt out in runs before it is expanded
    runs = (placed.where(F.col("n") > RUN)
            .withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
            .withColumn("rank", F.col("rank") + F.col("at"))
            .withColumn("n", F.least(F.col("n") - F.col("at"), F.lit(RUN))).drop("at")
            .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return (placed.where(F.col("n") <= RUN).unionByName(runs)
            .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("base") + F.col("rank") + F.col("k")).cast("long").alias("slot"), "cell"))
