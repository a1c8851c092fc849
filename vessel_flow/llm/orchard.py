"""Centroid clustering by Orchard search, in whole numbers.

Every round assigns each vector to its nearest centroid and moves the centroids
to the floored means of their vectors.  The nearest centroid is found by
Orchard's search: each centroid has a list of all others by rising distance.  A
vector walks the list of its present centroid; when it meets a closer one, it
goes on with that one's list from the start.  Centroids met before are marked
and passed over.  It stops at the first one that lies strictly beyond twice the
present distance, since by the triangle inequality neither it nor any behind it
can be nearer, or as near.  All vectors of a batch walk at once, each through
its own list.

Components are integers, so distances, sums and means are exact and do not
depend on the order of rows.  A round reads the vectors, sums them by centroid
inside each task, and Spark adds up those sums; only the sums of the centroids
(``k`` times the dimension) reach the driver, only centroids and lists go out.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component are left out; fewer vectors than ``k`` give as many
centroids; equal vectors may give equal centroids, of which the smaller number
wins; equal ids are ordered by their components when centroids are picked; a
null id hashes as ``null``; an empty table gives no rows; other columns are not
read.  A component beyond 2^27 in size ends the job with an error, since a
squared distance would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

LARGEST = 1 << 27


@dataclass(frozen=True)
class Params:
    k: int = 40
    rounds: int = 5
    dim: int = 64
    scale: int = 256
    seed: str = "2"


def to_grid(vectors: pa.Array, params: Params) -> np.ndarray:
    """floor(scale * x) of every component as an int64 matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    grid = np.floor(flat * params.scale)
    if len(grid) and np.abs(grid).max() > LARGEST:
        raise ValueError(f"a component lies beyond {LARGEST} once scaled: distances would not fit a long")
    return grid.astype(np.int64).reshape(len(vectors), params.dim)


class Lists:
    """The centroids with their neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        apart = centroids[:, None, :] - centroids[None, :, :]
        self.d = np.einsum("ijk,ijk->ij", apart, apart)
        # by distance, then number; the centroid itself (distance 0) need not be first
        self.order = np.argsort(self.d, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.d, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid; of equal
        distances the smaller number."""
        n, k = len(x), len(self.c)
        now = np.zeros(n, np.int64)
        dist = self._distance(x, now)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)  # place in the present centroid's list
        walk = np.arange(n)
        while len(walk):
            mine, place = now[walk], at[walk]
            inside = place < k
            # strictly beyond twice the distance; both sides are squares
            inside[inside] = self.sorted[mine[inside], place[inside]] <= 4 * dist[walk[inside]]
            walk = walk[inside]
            met = self.order[now[walk], at[walk]]
            at[walk] += 1
            new = ~seen[walk, met]
            some, met = walk[new], met[new]
            seen[some, met] = True
            d = self._distance(x[some], met)
            closer = (d < dist[some]) | ((d == dist[some]) & (met < now[some]))
            some = some[closer]
            now[some], dist[some], at[some] = met[closer], d[closer], 0
        return now, dist

    def _distance(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        apart = x - self.c[to]
        return np.einsum("ij,ij->i", apart, apart)


def kept(vectors: DataFrame, params: Params, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that can be clustered."""
    v = F.col(vector_col).cast("array<double>")
    sound = (F.size(v) == params.dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("vec_id"), v.alias("v"))


def start(rows: DataFrame, params: Params) -> np.ndarray:
    """The vectors with the smallest hashes: ``k`` rows reach the driver."""
    name = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = rows.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(params.k).collect()
    return to_grid(pa.array([r["v"] for r in first], pa.list_(pa.float64())), params)


def _moved(rows: DataFrame, lists, centroids: np.ndarray, params: Params) -> np.ndarray:
    """The centroids after one round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, total, count = len(lists.value.c), {}, {}
        for b in batches:
            x = to_grid(b.column(0), params)
            c, _ = lists.value.nearest(x)
            for i in np.unique(c).tolist():  # at most k sums, in numbers without bound
                mine = x[c == i]
                total[i] = total.get(i, 0) + mine.sum(axis=0).astype(object)
                count[i] = count.get(i, 0) + len(mine)
        at = [i for i in range(k) if i in count]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(at, params.dim + 1).astype(np.int32)),
            pa.array(np.tile(np.arange(params.dim + 1), len(at)).astype(np.int32)),
            pa.array([str(s) for i in at for s in [*total[i], count[i]]], pa.string())], ["c", "place", "part"])

    sums = (rows.select("v").mapInArrow(run, "c int, place int, part string")
            .groupBy("c", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect())
    found: dict[int, dict[int, int]] = {}
    for r in sums:  # at most k * (dim + 1) rows
        found.setdefault(r["c"], {})[r["place"]] = int(r["total"])
    out = centroids.copy()
    for c, parts in found.items():
        out[c] = [parts[j] // parts[params.dim] for j in range(params.dim)]
    return out


def fit(rows: DataFrame, params: Params) -> np.ndarray:
    """Centroids after all rounds; ``rows`` as ``kept`` gives them."""
    centroids = start(rows, params)
    for _ in range(params.rounds if len(centroids) else 0):
        held = rows.sparkSession.sparkContext.broadcast(Lists(centroids))
        centroids = _moved(rows, held, centroids, params)
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, params: Params) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""
    held = rows.sparkSession.sparkContext.broadcast(Lists(centroids)) if len(centroids) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, d = held.value.nearest(to_grid(b.column(1), params))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.astype(np.int32)), pa.array(d)],
                                             ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def by_cluster(values: dict[int, object], kind: str) -> Column:
    """A value for each cluster, as an expression over ``cluster``."""
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("cluster")).cast(kind)


def cluster(vectors: DataFrame, params: Params = Params(), id_col: str = "vec_id",
            vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of every vector
    that can be clustered, and the centroids.  Inertias beyond a long are null."""
    rows = kept(vectors, params, id_col, vector_col)
    centroids = fit(rows, params)
    found = common.stored(assign(rows, centroids, params), "orchard-clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    fits = lambda x: x if x < 1 << 63 else None
    inertia = fits(sum(int(r["d"]) for r in sums))
    return found.select(
        "vec_id", "cluster", "distance",
        by_cluster({r["cluster"]: fits(int(r["d"])) for r in sums}, "long").alias("cluster_inertia"),
        F.lit(inertia).cast("long").alias("inertia")), centroids
