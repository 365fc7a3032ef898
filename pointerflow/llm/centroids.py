"""Centroid clustering of vectors with Orchard search (op12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Scaled components lie within 2^27, so that squared distances of up to 64
#: components fit a long.
LARGEST = 1 << 27


class Orchard:
    """Nearest centroids by their sorted neighbour lists.

    A search goes down the list of its current centroid, jumps to the list of a
    closer one whenever it finds one, passes over centroids it has met before,
    and stops where the list's next neighbour lies strictly beyond twice the
    current distance: none from there on can be as close.  All vectors of a
    batch search side by side, one list entry a step.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        apart = np.array([((centroids - c) ** 2).sum(1) for c in centroids]).reshape(k, k)
        apart[np.arange(k), np.arange(k)] = -1  # itself is first, and left out
        self.lists = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.lists, 1)
        self.guessed_by = np.sort(np.argsort(-centroids.var(0), kind="stable")[:4])

    def _distance(self, vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
        off = vectors - self.centroids[to]
        return np.einsum("ij,ij->i", off, off)

    def _start(self, vectors: np.ndarray) -> np.ndarray:
        """Where to begin: close in the components that tell centroids apart best."""
        off = vectors[:, None, self.guessed_by] - self.centroids[None, :, self.guessed_by]
        return np.einsum("ijk,ijk->ij", off, off).argmin(1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of each
        vector; of equally near ones the smallest number."""
        n, k = len(vectors), len(self.centroids)
        at = self._start(vectors)
        best, distance, place = at.copy(), self._distance(vectors, at), np.zeros(n, np.int64)
        met = np.zeros((n, k), bool)
        met[np.arange(n), at] = True
        open_ = np.arange(n) if k > 1 else np.empty(0, np.int64)
        while len(open_):
            # four times the square: twice the distance
            open_ = open_[(place[open_] < k - 1) & (self.apart[at[open_], np.minimum(place[open_], k - 2)] <= 4 * distance[open_])]
            found = self.lists[at[open_], place[open_]]
            place[open_] += 1
            new = ~met[open_, found]
            rows, found = open_[new], found[new]
            met[rows, found] = True
            d = self._distance(vectors[rows], found)
            tied = (d == distance[rows]) & (found < best[rows])
            best[rows[tied]] = found[tied]
            closer = d < distance[rows]
            rows, found = rows[closer], found[closer]
            at[rows] = best[rows] = found
            distance[rows], place[rows] = d[closer], 0
        return best, distance


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("c").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def scaled_vectors(rows: DataFrame, size: int = 64, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and c, the components as integers ``floor(scale * x)``, of vectors
    with ``size`` components, none of them null, NaN or infinite.

    A component of 2^27 or more after scaling raises, as distances would not
    fit a long.
    """
    x = F.col("x")
    narrow = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.size(x) == size)
    whole = narrow.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    number = lambda v: F.when(F.abs(v) * scale < LARGEST, F.floor(v * float(scale)).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    return whole.select("vec_id", F.transform(x, number).alias("c"))


def _sums(kept: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    """cluster, n and sums: each task's vectors, added up by their centroid."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n = Orchard(centroids), np.zeros(len(centroids), np.int64)
        sums = np.zeros((len(centroids), size), np.int64)
        for batch in batches:
            vectors = _vectors(batch, size)
            cluster, _ = search.nearest(vectors)
            order = np.argsort(cluster, kind="stable")
            there, heads = np.unique(cluster[order], return_index=True)
            if len(there):
                sums[there] += np.add.reduceat(vectors[order], heads, axis=0)
                n += np.bincount(cluster, minlength=len(n))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full]), pa.array(sums[full].tolist(), schema.field("sums").type)], schema=schema)

    added = kept.select("c").mapInArrow(rows, "cluster int, n long, sums array<long>")
    return added.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(size))).alias("sums"))


def _assigned(kept: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for batch in batches:
            cluster, distance = search.nearest(_vectors(batch, size))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    return kept.mapInArrow(rows, "vec_id long, cluster int, distance long")


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256 with the seed; of
    rows with one id, and of those without one (last), the smaller vector."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(name.alias("name"), "c").orderBy(F.asc_nulls_last("name"), "c").limit(k).collect()
    return np.array([row.c for row in rows], np.int64)


def cluster_vectors(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of
    every vector that ``scaled_vectors`` keeps, after ``rounds`` of assigning
    vectors to their nearest centroid and moving centroids to the floor of
    their vectors' mean; one with no vectors stays.

    All arithmetic is exact, so neither partitions nor reruns change a result.
    The driver holds ``k`` centroids and their sums.  Other vectors have no row;
    repeated ones and those without an id count each; fewer than ``k`` vectors
    make as many centroids; an empty table gives no rows.  An inertia beyond a
    long is null.
    """
    kept = saved(scaled_vectors(rows, size, scale, id_col, vector_col), "scaled-vectors")
    centroids = first_centroids(kept, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], out)
    for _ in range(rounds):
        for row in _sums(kept, centroids, size).collect():
            centroids[row.cluster] = [s // row.n for s in row.sums]
    found = saved(_assigned(kept, centroids, size), "assigned-vectors")
    per_cluster = {row.cluster: int(row.inertia) for row in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("inertia")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    whole = long(sum(per_cluster.values()))
    facts = [(c, long(n), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in per_cluster.items()]
    of_cluster = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
