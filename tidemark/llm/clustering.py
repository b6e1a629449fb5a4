"""Centroid clustering with exact integer arithmetic; the nearest centroid is found by an annulus search.

By the triangle inequality a centroid nearer than ``reach`` to a vector has a norm within ``reach`` of the vector's. The
centroids are sorted by norm; the one nearest in norm gives the first reach, two binary searches give the run of
centroids whose norms lie in the annulus, and these alone are compared, by exact distances, those on its border too.

The vectors are written once as integers in the shared folder; each round is a pass over them in which a task keeps one
sum per centroid, so that a round moves no more than tasks x centroids x components numbers, and centroids x components numbers, a
bound that is independent of the data, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpointed
from tidemark.llm.vectors import integers, matrix, products, usable

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Annuli:
    """Centroids sorted by norm. ``nearest`` gives each row's centroid and squared distance; of equal ones the smaller number."""

    def __init__(self, centroids: list[list[int]]) -> None:
        points = np.array(centroids, np.int64)
        squares = (points * points).sum(axis=1)
        self.numbers = np.lexsort((np.arange(len(points)), squares))
        self.points, self.squares = points[self.numbers], squares[self.numbers]
        self.norms = np.sqrt(self.squares.astype(np.float64))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (rows * rows).sum(axis=1)
        norm = np.sqrt(own.astype(np.float64))
        slack = 1e-6 + 1e-9 * (norm + self.norms[-1])  # far above what rounding can do, so no tie on the border is lost

        after = np.searchsorted(self.norms, norm).clip(1, len(self.norms) - 1) if len(self.norms) > 1 else np.zeros(len(rows), np.int64)
        before = np.maximum(after - 1, 0)
        first = np.where(norm - self.norms[before] <= self.norms[after] - norm, before, after)
        best = own + self.squares[first] - 2 * (rows * self.points[first]).sum(axis=1)
        number = self.numbers[first]
        reach = np.sqrt(best.astype(np.float64)) + slack
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        for j in range(low.min(initial=len(self.norms)), high.max(initial=0)):
            at = np.flatnonzero((low <= j) & (j < high) & (np.abs(self.norms[j] - norm) <= reach) & (first != j))
            if not len(at):
                continue
            distance = own[at] + self.squares[j] - 2 * products(rows[at], self.points[j : j + 1])[:, 0]
            better = (distance < best[at]) | ((distance == best[at]) & (self.numbers[j] < number[at]))
            at, distance = at[better], distance[better]
            best[at], number[at] = distance, self.numbers[j]
            reach[at] = np.sqrt(distance.astype(np.float64)) + slack[at]
        return number, best


def _sums(centroids: list[list[int]]):
    """Of a partition's vectors, for each cluster that has any, rows (cluster, place, n, total), one for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k, width = Annuli(centroids), len(centroids), len(centroids[0])
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), width)
            number, _ = search.nearest(rows)
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                sums[c] += rows[number == c].sum(axis=0)
        some = np.flatnonzero(n)
        columns = [np.repeat(some, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(some)), np.repeat(n[some], width), sums[some].ravel()]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["cluster", "place", "n", "total"])

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annuli(centroids)
        for batch in batches:
            number, distance = search.nearest(matrix(batch.column(1), len(centroids[0])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """Per kept row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of ``width`` components, none null or non-finite; others, and null vectors, give no row. Components
    become floor(scale * x), between -2^27 and 2^27. The first centroids are the ``k`` vectors with the smallest sha256 of
    salt and vec_id (a null vec_id comes last, ties go by the components); with fewer vectors there are fewer centroids.
    Equal vectors and repeated rows are vectors of their own. An inertia beyond a long is null. An empty table gives no
    rows. Other columns are ignored.
    """
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    kept = checkpointed(found.filter(usable(F.col("vector")) & (F.size("vector") == width)).select("vec_id", integers(F.col("vector"), scale).alias("x")))
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    centroids = [list(r.x) for r in kept.select("x", order.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], RESULT)
    for _ in range(rounds):
        parts = kept.select("x").mapInArrow(_sums(centroids), "cluster int, place int, n long, total long")
        moved = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # k * width rows at most
        for row in moved:
            centroids[row.cluster][row.place] = row.total // row.n
    assigned = checkpointed(kept.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    in_long = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, in_long(inertia.get(c, 0)), in_long(sum(inertia.values())), digest[c]) for c in range(len(centroids))]
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
