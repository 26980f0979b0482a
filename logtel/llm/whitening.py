"""Whitening of embeddings: projection on the leading components of their covariance, each scaled to variance one.

Spark sums rows and centred products; the covariance matrix, whose size is
that of the dimensions squared, is decomposed by the driver:

1. *Householder tridiagonalisation* turns it into a tridiagonal matrix with
   the same eigenvalues.
2. *Sturm counts* tell how many eigenvalues lie below a number; bisection on
   them closes in on each of the leading eigenvalues by itself.
3. *Inverse iteration* gives the vector of each; vectors whose eigenvalues
   are close (a cluster) are orthogonalised against each other in every step.

The components are broadcast with the tasks that project the rows.

Results by case: a null vector, or one with a null or non-finite entry, is
dropped; so is one whose length is not the most frequent one (the longer, if
two are), as a covariance needs one length; a direction in which the vectors
do not vary at all cannot be scaled and is no component, so vectors that are
all equal give no rows; repeated rows are projected one by one; a null id
passes as null; extra columns are ignored; an empty table gives no rows. An
entry whose size is 2 ** 40 or more is an error, as products would not be
exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtel.llm.common import stored
from logtel.llm.vectors import covariance, double_sums, finite, rest_of_mean, rounded_mean, rows_of, scatter, whole_sums

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LARGEST = 1 << 40


# --- the symmetric eigenvalue problem ---------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with Q orthogonal and ``Q.T @ matrix @ Q`` tridiagonal."""
    a = np.array(matrix, dtype=np.float64)
    size = len(a)
    q = np.eye(size)
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        if not np.any(v[1:]):
            continue
        length = np.copysign(np.linalg.norm(v), v[0])
        v[0] += length
        v /= np.linalg.norm(v)
        # reflection of the trailing part from both sides, as an update of rank two
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = p - (v @ p) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -length
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each number of ``at``."""
    least = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    squares = off * off
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], squares):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        with np.errstate(over="ignore"):
            pivot = d - at - e / pivot
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    size = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    bound = max(np.max(np.abs(diagonal) + reach), np.finfo(np.float64).tiny)
    places = np.arange(size - 1, size - 1 - min(most, size), -1)
    low, high = np.full(len(places), -1.001 * bound), np.full(len(places), 1.001 * bound)
    for _ in range(200):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        # at most ``place`` eigenvalues are smaller than the one sought
        above = sturm_counts(diagonal, off, middle) <= places
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - value) x = right by elimination with row exchanges; pivots of zero become ``least``."""
    size = len(diagonal)
    d, u, uu, x = diagonal - value, np.append(off, 0.0), np.zeros(size), right.copy()
    for k in range(size - 1):
        under = off[k]
        if abs(d[k]) >= abs(under):
            if abs(d[k]) < least:
                d[k] = least
            factor = under / d[k]
            d[k + 1] -= factor * u[k]
            x[k + 1] -= factor * x[k]
        else:  # rows k and k + 1 change places
            factor = d[k] / under
            d[k], u[k], uu[k], d[k + 1], u[k + 1] = under, d[k + 1], u[k + 1], u[k] - factor * d[k + 1], -factor * u[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
    if abs(d[-1]) < least:
        d[-1] = least
    for k in range(size - 1, -1, -1):
        if k + 1 < size:
            x[k] -= u[k] * x[k + 1]
        if k + 2 < size:
            x[k] -= uu[k] * x[k + 2]
        x[k] /= d[k]
        if abs(x[k]) > 1e100:  # only the direction counts
            x /= abs(x[k])
    return x


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, close: float = 1e-3, steps: int = 6) -> np.ndarray:
    """Unit eigenvectors, one row for each of the falling ``values``."""
    size = len(diagonal)
    norm = max(float(np.max(np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.append(0, off)))), np.finfo(np.float64).tiny)
    least = np.finfo(np.float64).eps * norm
    rng = np.random.default_rng(11)
    vectors, first, shift = np.zeros((len(values), size)), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > close * norm:
            first = j
        # equal eigenvalues are solved for at numbers just apart, so that their systems differ
        shift = min(value, shift - 2 * least) if j > first else value
        x = rng.standard_normal(size)
        for _ in range(steps):
            x /= np.linalg.norm(x)
            x = _solved(diagonal, off, shift, x, least)
            x /= np.max(np.abs(x))
            for _ in range(2):  # the second time takes off what rounding of the first has left
                x -= vectors[first:j].T @ (vectors[first:j] @ x)
            if not np.any(x):
                x = rng.standard_normal(size)
        vectors[j] = x / np.linalg.norm(x)
    return vectors


def leading_components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of a symmetric matrix; the largest entry of a vector is positive."""
    scale = float(np.max(np.abs(matrix)))
    if not scale:
        return np.zeros(min(most, len(matrix))), np.eye(len(matrix))[:most]
    diagonal, off, q = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, most)
    vectors = inverse_iteration(diagonal, off, values) @ q.T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values * scale, vectors * signs[:, None]


# --- on a table -------------------------------------------------------------------------------------------------


def prepared(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, x): vectors of the most frequent length as whole numbers, stored."""
    kept = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).filter(finite(F.col("vector")))
    usual = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    whole = F.transform("vector", lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("bigint"))
    same = kept.filter(F.size("vector") == (usual["size"] if usual else 0))
    too_large = F.exists("vector", lambda c: F.abs(c.cast("double")) >= LARGEST / SCALE)
    x = F.when(too_large, F.raise_error(F.lit(f"an entry of {LARGEST // SCALE} or more"))).otherwise(whole)
    return stored(same.filter(F.size("vector") > 0).select("id", x.alias("x")), "whole-vectors")


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per row and component: ``id_column``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    kind = rows.schema[id_column].dataType.simpleString()
    table = prepared(rows, id_column, vector_column)
    n, sums = whole_sums(table, "x")
    empty = f"`{id_column}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return rows.sparkSession.createDataFrame([], empty)
    matrix = covariance(table, "x", n, sums)
    trace = float(np.trace(matrix))
    values, vectors = leading_components(matrix, most)
    varies = values > len(matrix) * np.finfo(np.float64).eps * trace
    values, vectors = values[varies], vectors[varies]
    if not len(values):
        return rows.sparkSession.createDataFrame([], empty)

    centre, rest = rounded_mean(n, sums), rest_of_mean(n, sums)
    left = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=np.int64)
    axes = vectors / np.sqrt(values)[:, None]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = rows_of(batch.column(1), np.int64) - centre if batch.num_rows else np.zeros((0, len(centre)), dtype=np.int64)
            white = (moved - rest) @ axes.T
            offsets = np.arange(len(moved) + 1, dtype=np.int32) * len(axes)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.reshape(-1)))
            yield pa.record_batch([batch.column(0), _deviations(moved, n, left), lists], names=["id", "deviation", "white"])

    schema = f"id {kind}, deviation decimal(38,0), white array<double>"
    projected = stored(table.mapInArrow(project, schema), "whitened")
    mean = double_sums(projected, "white", len(axes)) / n
    error = float(np.max(np.abs(scatter(projected, "white", mean) / n - np.eye(len(axes)))))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return projected.select("id", "deviation", F.posexplode("white").alias("place", "whitened")).select(
        F.col("id").alias(id_column),
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _deviations(moved: np.ndarray, n: int, left: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - S) squared, exact, for rows less the rounded mean."""
    largest = n * int(np.abs(moved).max(initial=0)) + int(np.abs(left).max(initial=0))
    if largest * largest * max(1, moved.shape[1]) < 1 << 63:
        found = ((n * moved - left) ** 2).sum(axis=1)
        return pa.array(found).cast(pa.decimal128(38, 0))
    exact = ((n * moved.astype(object) - left.astype(object)) ** 2).sum(axis=1)
    return pa.array([int(v) for v in exact], pa.decimal128(38, 0))
