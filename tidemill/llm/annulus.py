"""Clustering around centroids, with centroids sought in an annulus.

Centroids are sorted by their norm. A vector's distance to a centroid is never less than the difference of their norms, so
once some centroid is known to lie within a bound, only those with a norm within the bound of the vector's can be nearer:
they are found by binary search in the sorted norms, the ends included, and compared exactly. The bound is the distance to
the better of the two centroids whose norms enclose the vector's.

A round reads the vectors once: each task assigns its rows and sums them by centroid, and only these sums, one row for each
centroid and task, meet. The centroids, at most `clusters` rows, are the only thing the driver and every task hold.

Components become floor(scale * x) of x as double, and all arithmetic is exact. Defined results: a vector that is null, has
another number of components, or holds a null or non-finite one takes no part, nor does a null id; repeated ids are vectors
of their own, and where one of them starts a centroid, the smallest vector comes first; vectors at the same distance from
several centroids go to the smallest number; a centroid without vectors stays; fewer vectors than clusters: as many
centroids as vectors; an empty table gives an empty result; distances must fit in 53 bits, else the query fails. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

#: Rows that are compared at once.
ROWS = 8192


def _kept(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and scaled vectors of the rows of (vec_id, embedding) that take part."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, min(ROWS, batch.num_rows - at))
            ids, lists = part.column(0), part.column(1)
            good = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
            good &= np.diff(np.asarray(lists.offsets)) == size
            rows = lists.filter(pa.array(good))
            values = rows.flatten()
            real = np.asarray(values.is_valid()) & np.isfinite(np.asarray(values.fill_null(0.0)))
            fine = real.reshape(-1, size).all(axis=1)
            matrix = np.floor(np.asarray(values.fill_null(0.0)).reshape(-1, size)[fine] * scale)
            if matrix.size and (matrix**2).sum(axis=1).max() * 4 >= 2**53:
                raise ValueError("distances of these vectors do not fit in 53 bits")
            yield ids.filter(pa.array(good)).filter(pa.array(fine)), matrix


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        points = np.array(centroids, np.float64)
        norms = np.sqrt((points**2).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.points, self.norms = points[self.number], norms[self.number]
        self.squares = (self.points**2).sum(axis=1)
        self.compared = 0

    def _distance(self, rows: np.ndarray, squares: np.ndarray, place: np.ndarray) -> np.ndarray:
        return squares - 2 * np.einsum("ij,ij->i", rows, self.points[place]) + self.squares[place]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its nearest centroid, the smallest of equal ones, and the squared distance to it."""
        squares = (rows**2).sum(axis=1)
        norms = np.sqrt(squares)
        above = np.clip(np.searchsorted(self.norms, norms), 0, len(self.norms) - 1)
        below = np.maximum(above - 1, 0)
        bound = np.sqrt(np.minimum(self._distance(rows, squares, above), self._distance(rows, squares, below)))
        # square roots are rounded: the annulus is wider by more than that, and what it holds is compared in whole numbers
        slack = 1e-9 * (bound + norms + 1)
        low = np.searchsorted(self.norms, norms - bound - slack, side="left")
        high = np.searchsorted(self.norms, norms + bound + slack, side="right")
        best = np.full(len(rows), np.inf)
        chosen = np.full(len(rows), len(self.norms))
        for place, number in enumerate(self.number.tolist()):
            inside = np.flatnonzero((low <= place) & (place < high))
            if not len(inside):
                continue
            self.compared += len(inside)
            d = squares[inside] - 2 * (rows[inside] @ self.points[place]) + self.squares[place]
            nearer = (d < best[inside]) | (d == best[inside]) & (number < chosen[inside])
            best[inside[nearer]], chosen[inside[nearer]] = d[nearer], number
        return chosen, best.astype(np.int64)


def first_centroids(vectors: DataFrame, clusters: int, size: int, scale: int, seed: int) -> list[tuple[int, ...]]:
    """The vectors with the smallest SHA-256 of "seed:vec_id", in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, tuple[int, ...]]] = []
        for ids, matrix in _kept(batches, size, scale):
            keys = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids.to_pylist()]
            worst = held[-1][0] if len(held) == clusters else "~"
            held += [(k, tuple(map(int, row))) for k, row in zip(keys, matrix) if k <= worst]
            held = sorted(held)[:clusters]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([v for _, v in held], pa.list_(pa.int64()))], names=["key", "v"])

    best = vectors.mapInArrow(lean(run), "key string, v array<long>").orderBy("key", "v").limit(clusters)
    return [tuple(r.v) for r in best.collect()]  # as many rows as clusters


def moved(vectors: DataFrame, centroids: list[tuple[int, ...]], size: int, scale: int) -> list[tuple[int, ...]]:
    """The centroids after a round: each the floor of its vectors' mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, sums, counts = Annulus(centroids), np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
        for _, matrix in _kept(batches, size, scale):
            chosen, _ = near.nearest(matrix)
            order = np.argsort(chosen, kind="stable")
            numbers, at = np.unique(chosen[order], return_index=True)
            if len(numbers):
                sums[numbers] += np.add.reduceat(matrix[order].astype(np.int64), at, axis=0)
                counts += np.bincount(chosen, minlength=len(centroids))
        used = np.flatnonzero(counts)
        columns = [pa.array(used), pa.array(counts[used]), *(pa.array(sums[used, i]) for i in range(size))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *(f"s{i}" for i in range(size))])

    parts = [f"s{i}" for i in range(size)]
    sums = vectors.mapInArrow(lean(run), "cluster long, n long, " + ", ".join(f"{p} long" for p in parts))
    out = list(centroids)
    for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(p).alias(p) for p in parts)).collect():  # a row a centroid
        out[r.cluster] = tuple(r[p] // r.n for p in parts)
    return out


def assigned(vectors: DataFrame, centroids: list[tuple[int, ...]], size: int, scale: int) -> DataFrame:
    """vec_id, cluster, distance (squared) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(centroids)
        for ids, matrix in _kept(batches, size, scale):
            if len(ids):
                chosen, distance = near.nearest(matrix)
                yield pa.RecordBatch.from_arrays([ids, pa.array(chosen.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(lean(run), f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long")


def clustered(vectors: DataFrame, clusters: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = first_centroids(rows, clusters, size, scale, seed)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(rows, centroids, size, scale)
    out = cut(assigned(rows, centroids, size, scale))
    inertia = {r.cluster: r.d for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in enumerate(digest)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
