"""Centroid clustering by an incremental distance matrix.

Vectors become integers, and each keeps its exact dot products with all centroids beside it in a stored table. When
centroids move, a dot product changes by the sum of (change of a component) * (the vector's component), so a round
touches only the components that changed; then squared distances |x|^2 - 2 x.c + |c|^2 and the argmin follow exactly.
Sums of clusters are carried too: only vectors that changed their cluster are added and subtracted.

A round is one pass over the table, whose result is written to the shared folder, and a pass over the vectors that
moved. No row is shuffled. The driver holds the centroids, their sums and counts: 2 * k * width integers. The table
before the last is deleted once the next one stands, so the disk holds two; a lost executor repeats its part of one pass.

Defined cases: vectors with another width, a null vector, or any null or non-finite component are left out; repeated rows
are rows of their own; a row without id is clustered but never a first centroid while others are left; ties between
centroids go to the smaller number; with fewer vectors than k there are as many centroids; an empty table gives an empty
one. Components beyond LARGEST raise an error, as squared distances would not fit into 64 bits. Only the two named
columns are read, so others don't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barfold.llm.shared import new_folder

#: Largest integer component: (2 * LARGEST)^2 * width must stay below 2^63 up to a width of 2048.
LARGEST = 1 << 25
STATE = "vec_id long, x array<int>, norm long, dots array<long>, cluster int, was int, distance long"


def whole_vectors(df: DataFrame, width: int, scale: int, vec: str, embedding: str) -> DataFrame:
    """(vec_id, x): components as integers floor(scale * x), of vectors with width finite components."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    good = (F.size(e) == width) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall("x", lambda v: F.abs(v) <= LARGEST)
    whole = F.transform(e, lambda x: F.floor(x * float(scale)))
    rows = df.select(F.col(f"`{vec}`").cast("long").alias("vec_id"), F.when(good, whole).alias("x")).filter(F.col("x").isNotNull())
    checked = F.when(fits, F.col("x").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}")))
    return rows.select("vec_id", checked.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hash of their id, in that order; equal hashes go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.x) for r in vectors.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()]


class Centroids:
    """Centroids with exact sums and counts of their clusters."""

    def __init__(self, points: list[list[int]]):
        self.points = points
        width = len(points[0]) if points else 0
        self.sums = [[0] * width for _ in points]
        self.counts = [0] * len(points)

    def moved(self, changes: DataFrame) -> list[list[int]]:
        """Take in the changes (cluster, n, sums) and return each centroid's change by component; empty ones stay."""
        for r in changes.collect():  # one row for each cluster
            self.counts[r.cluster] += r.n
            self.sums[r.cluster] = [a + b for a, b in zip(self.sums[r.cluster], r.sums, strict=True)]
        new = [[s // n for s in sums] if n else old for sums, n, old in zip(self.sums, self.counts, self.points, strict=True)]
        delta = [[a - b for a, b in zip(x, y, strict=True)] for x, y in zip(new, self.points, strict=True)]
        self.points = new
        return delta


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _rows(flat: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    edges = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.reshape(-1), kind))


def _assigned(batch: pa.RecordBatch, x: np.ndarray, norm: np.ndarray, dots: np.ndarray, lengths: np.ndarray, was: np.ndarray) -> pa.RecordBatch:
    far = norm[:, None] - 2 * dots + lengths[None, :]
    nearest = far.argmin(axis=1)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0), _rows(x, pa.int32()), pa.array(norm), _rows(dots, pa.int64()),
            pa.array(nearest.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(far[np.arange(len(far)), nearest]),
        ],
        names=["vec_id", "x", "norm", "dots", "cluster", "was", "distance"],
    )


def begin(vectors: DataFrame, points: list[list[int]]) -> DataFrame:
    """The first matrix: whole dot products, and an assignment from nowhere (was -1)."""
    c = np.array(points, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (c * c).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), c.shape[1])
                yield _assigned(batch, x, (x * x).sum(axis=1), x @ c.T, lengths, np.full(len(x), -1))

    return vectors.mapInArrow(run, STATE)


def update(state: DataFrame, points: list[list[int]], delta: list[list[int]]) -> DataFrame:
    """The matrix after centroids moved by delta: dot products change by the changed components alone."""
    c = np.array(points, np.int64)
    changes = [(j, at, np.array(row, np.int64)[at]) for j, row in enumerate(delta) if len(at := np.flatnonzero(np.array(row, np.int64)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (c * c).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                x, dots = _matrix(batch.column("x"), c.shape[1]), _matrix(batch.column("dots"), len(c)).copy()
                for j, at, by in changes:
                    dots[:, j] += x[:, at] @ by
                yield _assigned(batch, x, batch.column("norm").to_numpy(), dots, lengths, batch.column("cluster").to_numpy())

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, k: int, width: int) -> DataFrame:
    """(cluster, n, sums): what the vectors that changed their cluster add to and take from each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), width)
                for column, sign in (("cluster", 1), ("was", -1)):
                    to = batch.column(column).to_numpy()
                    for j in range(k):
                        rows = to == j
                        total[j] += sign * x[rows].sum(axis=0)
                        count[j] += sign * int(rows.sum())
        some = np.flatnonzero(np.abs(total).sum(axis=1) + np.abs(count))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), _rows(total[some], pa.int64())], names=["cluster", "n", "sums"])

    parts = state.filter("cluster <> was").select("x", "cluster", "was").mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = [F.sum(F.element_at("sums", i + 1)) for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums"))


class _Stored:
    """States in the shared folder; the one before the last goes when the next stands."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def put(self, state: DataFrame) -> DataFrame:
        folder = new_folder(self.spark)
        state.write.parquet(folder)
        self.folders.append(folder)
        if len(self.folders) > 2:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop(0))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(STATE).parquet(folder)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, vec: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, x, cluster, distance of every kept vector; the final centroids)."""
    spark = df.sparkSession
    vectors = whole_vectors(df, width, scale, vec, embedding)
    points = first_centroids(vectors, k, seed)
    if not points:
        return vectors.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    stored, centroids = _Stored(spark), Centroids(points)
    state = stored.put(begin(vectors, points))
    for _ in range(rounds):
        delta = centroids.moved(changes(state, len(points), width))
        if not any(map(any, delta)):  # nothing moves any more: all further rounds would be the same
            break
        state = stored.put(update(state, centroids.points, delta))
    return state.select("vec_id", "x", "cluster", "distance"), centroids.points


def summary(clustered: DataFrame, points: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = clustered.sparkSession
    sums = {r.cluster: int(r.s) for r in clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    rows = [(j, sums.get(j, 0), total, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for j, p in enumerate(points)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.drop("x").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
