"""Centroid clustering with filtering on rotated coordinates.

Vectors of whole numbers are moved to their mean and turned onto their
principal components. Of each vector the leading coordinates are stored, and
the norm of what they leave out. For a vector and a centroid the squared
distance of the leading coordinates plus the squared difference of the two
norms never exceeds their squared distance, so a centroid whose bound is
above a distance already known cannot be the nearest. The centroids left over
are compared in whole numbers; the rotation only decides how many those are.

Assignment is a pass without a shuffle; an update sums vectors within each
task first, so a cluster of any size sends one sum a task and dimension. The
driver holds centroids and their sums.

Results by case: a vector that is null, has not ``dimensions`` components, or
holds a null or non-finite one is dropped; equal distances go to the centroid
with the smaller number; vectors with equal hash (a repeated id) are ordered
by their components, and each may be a centroid; a null id hashes as the
empty text; with fewer vectors than centroids there are as many centroids as
vectors; repeated rows are assigned one by one; extra columns are ignored; an
empty table gives no rows. A component whose whole number is 2 ** 27 or more
in size is an error, as squared distances would not fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtel.llm.common import stored
from logtel.llm.vectors import ROWS_AT_ONCE, covariance, finite, rows_of, whole_sums
from logtel.llm.whitening import leading_components

SCALE = 64
LARGEST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """Parameters: components of a vector, centroids, rounds, the seed of the hash, and coordinates that are stored."""

    dimensions: int = 64
    centroids: int = 16
    rounds: int = 3
    seed: int = 1
    leading: int = 12


@dataclass(frozen=True)
class Rotation:
    """Principal axes, one for each row, through the mean."""

    mean: np.ndarray
    axes: np.ndarray

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leading coordinates, norm of the rest) of the rows of ``x``."""
        moved = x - self.mean
        leading = moved @ self.axes.T
        return leading, np.linalg.norm(moved - leading @ self.axes, axis=1)


def bounds(leading: np.ndarray, rest: np.ndarray, of_leading: np.ndarray, of_rest: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances between rows and centroids, less what rounding may add."""
    apart = leading[:, None, :] - of_leading[None, :, :]
    found = np.einsum("rcd,rcd->rc", apart, apart) + (rest[:, None] - of_rest[None, :]) ** 2
    sizes = (leading**2).sum(axis=1)[:, None] + rest[:, None] ** 2 + (of_leading**2).sum(axis=1)[None, :] + of_rest[None, :] ** 2
    return found - 1e-9 * (1 + sizes)


def nearest(x: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, squared distance, number of centroids compared in whole numbers) of each row."""
    chosen = lower.argmin(axis=1)
    least = ((x - centroids[chosen]) ** 2).sum(axis=1)
    left = lower <= least[:, None]
    for c in range(len(centroids)):
        rows = np.flatnonzero(left[:, c] & (chosen != c))
        if len(rows):
            distance = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
            better = (distance < least[rows]) | (distance == least[rows]) & (c < chosen[rows])
            chosen[rows[better]], least[rows[better]] = c, distance[better]
    return chosen, least, left.sum(axis=1)


def prepared(rows: DataFrame, spec: Clustering, id_column: str, vector_column: str) -> DataFrame:
    """(id, x): the vectors that are kept, as whole numbers."""
    vector = F.col("vector")
    kept = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).filter((F.size(vector) == spec.dimensions) & finite(vector))
    too_large = F.exists(vector, lambda c: F.abs(c.cast("double")) >= LARGEST / SCALE)
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    return kept.select("id", F.when(too_large, F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more"))).otherwise(whole).alias("x"))


def first_centroids(table: DataFrame, spec: Clustering) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    named = F.concat(F.lit(f"{spec.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chosen = table.select(F.sha2(named, 256).alias("hash"), "x").orderBy("hash", "x").limit(spec.centroids).collect()
    return np.array([r.x for r in chosen], dtype=np.int64).reshape(len(chosen), spec.dimensions)


def rotated(table: DataFrame, spec: Clustering) -> tuple[DataFrame, Rotation]:
    """The table with ``leading`` and ``rest`` of every vector, stored, and the rotation that made them."""
    n, sums = whole_sums(table, "x")
    matrix = covariance(table, "x", n, sums)
    turn = Rotation(np.array([s / n for s in sums]), leading_components(matrix, spec.leading)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leading, rest = turn.project(rows_of(batch.column(1)))
                offsets = pa.array(np.arange(len(leading) + 1, dtype=np.int32) * leading.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(leading.reshape(-1)))
                yield pa.record_batch([*batch.columns, lists, pa.array(rest)], names=["id", "x", "leading", "rest"])

    kind = table.schema["id"].dataType.simpleString()
    return stored(table.mapInArrow(run, f"id {kind}, x array<int>, leading array<double>, rest double"), "rotated"), turn


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, turned: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """(first row, vectors, centroid, squared distance, compared) of the batch's rows in portions; x, leading and rest are its last columns."""
    x, leading, rest = batch.columns[-3:]
    if not batch.num_rows:
        return
    x, leading, rest = rows_of(x, np.int64), rows_of(leading), rest.to_numpy()
    for lo in range(0, len(x), ROWS_AT_ONCE):
        part = slice(lo, lo + ROWS_AT_ONCE)
        yield lo, x[part], *nearest(x[part], bounds(leading[part], rest[part], *turned), centroids)


def updated(table: DataFrame, turn: Rotation, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of each cluster's mean; an empty cluster's centroid stays."""
    turned = turn.project(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, sizes = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, x, chosen, _, _ in _assigned(batch, centroids, turned):
                for c in np.unique(chosen):
                    own = x[chosen == c]
                    totals[c] += own.sum(axis=0)
                    sizes[c] += len(own)
        there = np.flatnonzero(sizes)
        cluster, place = np.repeat(there, totals.shape[1]), np.tile(np.arange(totals.shape[1]), len(there))
        yield pa.record_batch(
            [pa.array(cluster), pa.array(place), pa.array(totals[there].reshape(-1)), pa.array(sizes[cluster])],
            names=["cluster", "place", "total", "size"],
        )

    parts = table.select("x", "leading", "rest").mapInArrow(run, "cluster bigint, place bigint, total bigint, size bigint")
    moved = centroids.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("size").alias("size")).collect():
        moved[r.cluster, r.place] = r.total // r.size
    return moved


def cluster(rows: DataFrame, spec: Clustering = Clustering(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per kept vector: ``id_column``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``compared``."""
    kind = rows.schema[id_column].dataType.simpleString()
    table = stored(prepared(rows, spec, id_column, vector_column), "whole-vectors")
    centroids = first_centroids(table, spec)
    if not len(centroids):
        columns = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, compared int"
        return rows.sparkSession.createDataFrame([], f"`{id_column}` {kind}, {columns}")
    table, turn = rotated(table, spec)
    for _ in range(spec.rounds):
        centroids = updated(table, turn, centroids)
    turned = turn.project(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x, chosen, least, compared in _assigned(batch, centroids, turned):
                ids = batch.column(0).slice(lo, len(x))
                yield pa.record_batch(
                    [ids, pa.array(chosen.astype(np.int32)), pa.array(least), pa.array(compared.astype(np.int32))],
                    names=["id", "cluster", "distance", "compared"],
                )

    final = stored(table.mapInArrow(assign, f"id {kind}, cluster int, distance bigint, compared int"), "clusters")
    inertia = {r.cluster: r.inertia for r in final.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    sums = F.array(*[F.lit(inertia.get(c, 0)).cast("bigint") for c in range(len(centroids))])
    return final.select(
        F.col("id").alias(id_column),
        "cluster",
        "distance",
        sums[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.array(*[F.lit(d) for d in digests])[F.col("cluster")].alias("centroid_sha256"),
        "compared",
    )
