"""Centroid clustering of integer vectors with scalar lookup tables.

Components become integers. In each round a task tabulates, for every dimension, the squared difference of
each integer value that occurs there to each centroid; the distance of a vector is then a sum of table
entries, gathered by NumPy. Only sums and counts per cluster and task are shuffled, the vectors stay
where they are scanned. All sums are whole numbers, so the result does not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.tables import free_name, stored

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
ROWS = 8192  # vectors whose distances are held at a time
LARGEST = 1 << 28  # of an integer component: any distance then fits a long


def usable(vectors: DataFrame, dimensions: int, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _vector) of the vectors with exactly ``dimensions`` finite components."""
    values = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("_id"), values.alias("_vector")).where(
        (F.size("_vector") == dimensions) & F.forall("_vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    )


def to_grid(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, a row each."""
    column = batch.column("_vector")
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions) * SCALE)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ArithmeticError(f"a component is beyond {LARGEST} / {SCALE}: distances would not fit a long")
    return scaled.astype(np.int64)


def distances(grid: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid, by one lookup table per dimension."""
    total = np.zeros((len(grid), len(centroids)), np.int64)
    for d in range(grid.shape[1]):
        occurring, place = np.unique(grid[:, d], return_inverse=True)
        table = (occurring[:, None] - centroids[:, d]) ** 2
        total += table[place]
    return total


def nearest(grid: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (the smaller of equally near ones) and distance of each row."""
    clusters, least = np.zeros(len(grid), np.int32), np.zeros(len(grid), np.int64)
    for a in range(0, len(grid), ROWS):
        found = distances(grid[a : a + ROWS], centroids)
        clusters[a : a + ROWS] = found.argmin(1)
        least[a : a + ROWS] = found[np.arange(len(found)), clusters[a : a + ROWS]]
    return clusters, least


def _summed(centroids: np.ndarray):
    """One row per cluster and task: how many vectors it has there, and their componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            grid = to_grid(batch, centroids.shape[1])
            clusters, _ = nearest(grid, centroids)
            order = np.argsort(clusters, kind="stable")
            found, first = np.unique(clusters[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(grid[order], first, axis=0)
                counts += np.bincount(clusters, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, least = nearest(to_grid(batch, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(clusters), pa.array(least)], ["_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, clusters: int, dimensions: int, seed: str = "1") -> np.ndarray:
    """The vectors whose ids have the smallest hashes; equal ids go by their components, null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"), 256)
    chosen = rows.orderBy(order.asc_nulls_last(), F.col("_vector")).limit(clusters).toArrow()
    return np.concatenate([np.zeros((0, dimensions), np.int64), *[to_grid(b, dimensions) for b in chosen.to_batches()]])


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; a centroid without vectors stays."""
    k, dimensions = centroids.shape
    partial = rows.mapInArrow(_summed(centroids), "cluster int, n bigint, sums array<bigint>")
    wide = partial.select("cluster", "n", *[F.col("sums")[d].cast("decimal(38,0)").alias(f"s{d}") for d in range(dimensions)])
    totals = wide.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{d}").alias(f"s{d}") for d in range(dimensions)]).collect()  # <= k rows
    out = centroids.copy()
    for row in totals:
        out[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(dimensions)]
    return out


def centroid_clusters(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) per usable vector, and the final centroids.

    Null vectors and those with another number of components or with null or non-finite ones take no part. Repeated
    rows count each; with fewer vectors than ``clusters`` there are as many centroids as vectors; an empty table
    gives no rows. A component of 2**22 or more in size is an error, since distances would not fit a long.
    Other columns are not read.
    """
    rows = usable(vectors, dimensions, id_col, vector_col)
    centroids = first_centroids(rows, clusters, dimensions)
    kind = rows.schema["_id"].dataType.simpleString()
    if not len(centroids):
        return rows.select(F.col("_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return rows.mapInArrow(_assigned(centroids), f"_id {kind}, cluster int, distance bigint").withColumnRenamed("_id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the distances summed over its cluster and over all, and its centroid's SHA-256."""
    spark, assigned = assigned.sparkSession, stored(assigned, "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # <= clusters
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    name = free_name(assigned, "_cluster")
    facts = spark.createDataFrame(
        [(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()], f"{name} int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col(name)).drop(name)
