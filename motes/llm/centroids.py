"""Clustering around centroids with Ptolemaic pivots.

Vectors have `dims` whole components (vectors.packed_vectors). Centroids start as the k vectors with the smallest sha256 of `2:<vec_id>`; each of `rounds` rounds
assigns every vector to the nearest centroid (squared Euclidean distance; ties: smaller number) and moves every centroid that has vectors to the
componentwise floor of their mean. A last assignment follows.

Pivots are fixed: PIVOTS of the first centroids, each farthest from those before it. The distances of every vector to them are computed once and kept with it.
For pivots p, s, vector x and centroid c, Ptolemy's inequality gives d(x,c) d(p,s) >= |d(x,p) d(c,s) - d(x,s) d(c,p)|: a lower bound from cached distances. The
centroid with the least bound is measured exactly; others are measured, exactly as well, only where their bound, lowered by more than all rounding, does
not exceed that. Between rounds only sums and counts of the k clusters reach the driver: k * (dims + 1) numbers.

Defined results: rows whose vector is null, has another length, or a null or non-finite component or one beyond vectors.LIMIT are left out; rows that repeat
a vec_id are rows each, equal hashes going by vector; null vec_ids come last among the hashes; fewer than k rows give as many centroids; equal centroids
leave the larger number empty, and empty centroids stay where they are; an empty table gives no row. Columns other than the two are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, table
from .vectors import packed_vectors, unpacked

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
PIVOTS = 6
#: Far above the relative rounding of the few double operations behind a bound, each of which is below 2.3e-16.
SLACK = 1e-12
#: Rows measured at a time.
BATCH = 1 << 14


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to the row b, exact."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


def chosen_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """The first point, then each time the one farthest from those before it; distinct points only."""
    at, nearest = [0], squared(points, points[0])
    while len(at) < n and nearest.max() > 0:
        at.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(points, points[at[-1]]))
    return points[at]


class Nearest:
    """Finds nearest centroids of vectors whose distances to the pivots are known."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        to = lambda points: np.sqrt(np.stack([squared(points, p) for p in pivots], axis=1).astype(np.float64))
        self.to_pivots, between = to(centroids), to(pivots)
        self.pairs = [(p, s, between[p, s]) for p in range(len(pivots)) for s in range(p)]

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance of each vector (row) to each centroid (column), from the vectors' distances to the pivots."""
        out = np.zeros((len(cached), len(self.centroids)))
        for p, s, apart in self.pairs:
            one, other = cached[:, p, None] * self.to_pivots[:, s], cached[:, s, None] * self.to_pivots[:, p]
            np.maximum(out, (np.abs(one - other) - SLACK * (one + other)) / apart, out=out)
        return out

    def __call__(self, vectors: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each vector, and how many distances were measured."""
        bound = self.bounds(cached)
        cluster = bound.argmin(axis=1)
        apart = vectors - self.centroids[cluster]
        best = np.einsum("ij,ij->i", apart, apart)
        first, measured = cluster.copy(), len(vectors)
        for c, centroid in enumerate(self.centroids):
            at = np.flatnonzero((bound[:, c] * (1 - SLACK) <= np.sqrt(best.astype(np.float64)) * (1 + SLACK)) & (first != c))
            got = squared(vectors[at], centroid)
            better = (got < best[at]) | ((got == best[at]) & (c < cluster[at]))
            best[at[better]], cluster[at[better]] = got[better], c
            measured += len(at)
        return cluster, best, measured


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _prepared(rows: DataFrame, dims: int, pivots: np.ndarray | None = None) -> DataFrame:
    """vec_id, packed vector v and its distances to the pivots, if given, as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            keep, vectors = packed_vectors(batch.column("embedding"), dims)
            ids = batch.column("vec_id").filter(pa.array(keep))
            far = np.zeros((len(vectors), 0))
            if pivots is not None and len(vectors):
                points = unpacked(vectors)
                far = np.sqrt(np.stack([squared(points, p) for p in pivots], axis=1).astype(np.float64))
            data = far.tobytes()
            width = 8 * far.shape[1]
            yield pa.RecordBatch.from_arrays([ids, vectors, pa.array([data[i * width : (i + 1) * width] for i in range(len(far))], pa.binary())], names=["vec_id", "v", "far"])

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, v binary, far binary")


def _assigned(nearest: Nearest, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with their vectors, clusters and squared distances."""
    for batch in _pieces(batches):
        if batch.num_rows:
            vectors = unpacked(batch.column("v"))
            cached = np.frombuffer(b"".join(batch.column("far").to_pylist())).reshape(len(vectors), -1)
            cluster, distance, _ = nearest(vectors, cached)
            yield batch, vectors, cluster, distance


def moved(held: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round over the prepared vectors."""
    nearest, (k, dims) = Nearest(centroids, pivots), centroids.shape
    names = [f"s{i}" for i in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, vectors, cluster, _ in _assigned(nearest, batches):
            order = np.argsort(cluster, kind="stable")
            which, first = np.unique(cluster[order], return_index=True)
            total[which] += np.add.reduceat(vectors[order], first, axis=0)
            count += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(count), *map(pa.array, total.T)], names=["cluster", "n", *names])

    sums = held.mapInArrow(run, "cluster long, n long, " + ", ".join(f"{s} long" for s in names))
    out = centroids.copy()
    for row in sums.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect():
        if row.n:
            out[row.cluster] = [row[s] // row.n for s in names]
    return out


def clustered(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, prefix: str = "2:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for rows with vec_id and embedding."""
    spark = rows.sparkSession
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    first = _prepared(rows, dims).orderBy(F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(clusters).select("v").collect()
    if not first:
        return spark.createDataFrame([], names)
    centroids = unpacked([bytes(r.v) for r in first])
    pivots = chosen_pivots(centroids, PIVOTS)
    held = stash(_prepared(rows, dims, pivots), "vectors")
    for _ in range(rounds):
        centroids = moved(held, centroids, pivots)
    nearest = Nearest(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance in _assigned(nearest, batches):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    placed = stash(held.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = sum(inertia.values())
    # one row a centroid
    of = spark.createDataFrame([(c, d, total, digest[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _oracle() -> str:
    steps = ["""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS k, v AS c FROM kept QUALIFY k < 40)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (
  SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1
)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (
  SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(range(64)) AS j, unnest(v) AS x FROM a{i}) GROUP BY k, j
), c{i + 1} AS (
  SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY k) USING (k)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""


ORACLE = _oracle()
