"""Centroid clustering of integer vectors by sort-means: Lloyd's rounds that give what a full search gives.

Each round orders, for every centroid, the other ones by their distance from it. A vector starts at the centroid it was
assigned to before and looks at the others in that centroid's order, until one lies strictly beyond twice the
vector's own distance from where it started: by the triangle inequality that one and all after it are farther. All is done
in integers, on squared distances (beyond twice is beyond four times), so ties are exact and go to the smaller number.

Vectors are kept as a table of packed integers with their cluster, which each round writes anew and the round before
loses; sums are taken of it by task, then by cluster and component, so what comes to the driver is centroids times components.

Vectors that are null, of another length or with null or non-finite components are left out. Components are clamped to
2 ** 27 before and after scaling, as squared distances would no longer fit 64 bits. Null keys count as empty text in the
start's order, in which ties (repeated keys) go by the vector; repeated rows are vectors of their own. With fewer
vectors than clusters every vector is a start; of equal centroids the larger numbers stay empty, and empty ones stay as they are.
Empty tables give no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

LARGEST = 1 << 27
#: Vectors that are assigned at a time.
ROWS = 4096


def packed(table: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """(key, packed, cluster): floor(scale * x) of vectors with exactly size finite components, as little-endian 32-bit integers, all of cluster 0."""
    have = table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(F.size("vector") == size)
    kind = have.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = column.flatten()
            x = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)  # nulls become nan
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * np.clip(x[fine], -LARGEST, LARGEST)), -LARGEST, LARGEST).astype("<i4")
            yield pa.record_batch([batch.column(0).filter(pa.array(fine)), _binary(q), pa.array(np.zeros(len(q), np.int32))], ["key", "packed", "cluster"])

    return have.mapInArrow(run, f"key {kind}, packed binary, cluster int")


def _binary(q: np.ndarray) -> pa.Array:
    width = q.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(np.arange(len(q) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(q).tobytes())])


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """The packed vectors of a column without nulls, as 64-bit integers."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i4", (at[-1] - at[0]) // 4, at[0]).astype(np.int64).reshape(len(column), size)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Order:
    """Centroids and, for each, the others by their distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.apart = np.stack([squared(centroids, c) for c in centroids])
        self.near = [[j for j in np.argsort(row, kind="stable") if j != i] for i, row in enumerate(self.apart)]

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector, whose cluster was `before`."""
        best, least = before.copy(), np.empty(len(x), np.int64)
        for i in np.unique(before):
            own = np.flatnonzero(before == i)
            least[own] = start = squared(x[own], self.centroids[i])
            for j in self.near[i]:
                go_on = self.apart[i, j] <= 4 * start  # at exactly twice the distance j may be as near, with a smaller number
                own, start = own[go_on], start[go_on]
                if not len(own):
                    break
                d = squared(x[own], self.centroids[j])
                better = (d < least[own]) | ((d == least[own]) & (j < best[own]))
                least[own[better]], best[own[better]] = d[better], j
        return best, least


def _assigned(vectors: DataFrame, order: Order) -> DataFrame:
    """vectors with new clusters, and distance."""
    kind, size = vectors.schema["key"].dataType.simpleString(), order.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                cluster, distance = order.assign(_vectors(part.column(1), size), part.column(2).to_numpy())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["key", "packed", "cluster", "distance"])

    return vectors.select("key", "packed", "cluster").mapInArrow(run, f"key {kind}, packed binary, cluster int, distance long")


def _sums(vectors: DataFrame, size: int) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and sums of components of each cluster; a task sends a row for each cluster it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x, cluster = _vectors(part.column(0), size), part.column(1).to_numpy()
                for i in np.unique(cluster):
                    own = x[cluster == i]
                    n, total = found.get(i, (0, 0))
                    found[i] = n + len(own), total + own.sum(axis=0)
        if found:
            yield pa.record_batch([pa.array([int(i) for i in found], pa.int32()), pa.array([n for n, _ in found.values()]), pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    partial = vectors.select("packed", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    rows = partial.select("cluster", "n", F.posexplode("sums").alias("at", "sum")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect()
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r["cluster"], (r["n"], np.zeros(size, np.int64)))[1][r["at"]] = r["sum"]
    return out


def starts(vectors: DataFrame, clusters: int, seed: int, size: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of seed and key, in that order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(text.cast("binary"), 256).alias("hash"), "packed").orderBy("hash", "packed").limit(clusters).collect()
    return np.array([np.frombuffer(r["packed"], "<i4") for r in first], np.int64).reshape(-1, size)


def cluster(ws: Workspace, table: DataFrame, key: str, vector: str, size: int = 64, clusters: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance), centroids): every vector's cluster by the last centroids, and its squared distance."""
    vectors = ws.keep(packed(table, key, vector, size, scale), "vectors")
    centroids = starts(vectors, clusters, seed, size)
    if not len(centroids):
        return vectors.select("key", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    for round_ in range(rounds + 1):
        after = ws.keep(_assigned(vectors, Order(centroids)), f"round{round_ + 1}")
        ws.drop(vectors)
        vectors = after
        if round_ < rounds:
            for i, (n, total) in _sums(vectors, size).items():
                centroids[i] = total // n
    return vectors.select("key", "cluster", "distance"), centroids


def summed_up(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256, from one row for each cluster."""
    spark = assigned.sparkSession
    per = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, per.get(i, 0), sum(per.values()), digest(c)) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(rows, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), F.col("cluster") == F.col("number")).drop("number")
