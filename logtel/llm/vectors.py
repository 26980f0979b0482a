"""Sums over the rows of a vector column: what clustering and whitening both need.

A task adds its own rows up and emits one row for each entry of its sum;
Spark adds those up. What reaches the driver has the size of the model
(dimensions squared at most), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose products are formed at once.
ROWS_AT_ONCE = 4096


def finite(vector: Column) -> Column:
    """Whether there is a vector, and each of its entries is a finite number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def rows_of(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix with one row for each."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1)


def whole_sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """(number of rows, exact sum by dimension) of a column of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = rows_of(batch.column(0), np.int64).sum(axis=0)
                n, total = n + batch.num_rows, part if total is None else total + part
        if n:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["place", "total", "n"])

    parts = df.select(vector).mapInArrow(run, "place bigint, total bigint, n bigint")
    summed = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    found = sorted((r.place, int(r.total), r.n) for r in summed)
    return (found[0][2] if found else 0), [total for _, total, _ in found]


def double_sums(df: DataFrame, vector: str, dimensions: int) -> np.ndarray:
    """Sum by dimension of a column of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimensions)
        for batch in batches:
            total += rows_of(batch.column(0)).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(dimensions)), pa.array(total)], names=["place", "total"])

    parts = df.select(vector).mapInArrow(run, "place bigint, total double").groupBy("place").agg(F.sum("total").alias("total"))
    found = np.zeros(dimensions)
    for place, total in parts.collect():
        found[place] = total
    return found


def scatter(df: DataFrame, vector: str, centre: np.ndarray) -> np.ndarray:
    """Sum of the outer products of (row - centre): rows are centred before anything is multiplied.

    Whole numbers with a whole centre stay exact, and their sum independent of
    its order, as long as it is below 2 ** 53.
    """
    at = np.triu_indices(len(centre))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)))
        for batch in batches:
            x = rows_of(batch.column(0), centre.dtype.type)
            for lo in range(0, len(x), ROWS_AT_ONCE):
                moved = (x[lo : lo + ROWS_AT_ONCE] - centre).astype(np.float64)
                total += moved.T @ moved
        yield pa.record_batch([pa.array(np.arange(len(at[0]))), pa.array(total[at])], names=["place", "total"])

    parts = df.select(vector).mapInArrow(run, "place bigint, total double").groupBy("place").agg(F.sum("total").alias("total"))
    found = np.zeros((len(centre), len(centre)))
    for place, total in parts.collect():
        found[at[0][place], at[1][place]] = found[at[1][place], at[0][place]] = total
    return found


def covariance(df: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """Covariance, divisor ``n``, of a column of whole numbers with the given sums.

    Rows are centred on the mean rounded to whole numbers, so that every
    product is exact, and what rounding left is taken off afterwards.
    """
    centre = rounded_mean(n, sums)
    rest = rest_of_mean(n, sums)
    return scatter(df, vector, centre) / n - np.outer(rest, rest)


def rounded_mean(n: int, sums: list[int]) -> np.ndarray:
    return np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)


def rest_of_mean(n: int, sums: list[int]) -> np.ndarray:
    """Mean minus rounded mean, from whole numbers."""
    return np.array([(s - n * int(c)) / n for s, c in zip(sums, rounded_mean(n, sums))])
