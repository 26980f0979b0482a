"""Whitening against a library's eigenvectors, and its parts against their definitions."""

import math
import random

import numpy as np
import pytest
from comparing import DATA

from logtel.llm import whitening as w
from logtel.llm.common import table
from logtel.llm.queries import QUERIES


def random_symmetric(seed, size, values=None):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = rng.standard_normal(size) if values is None else np.asarray(values, dtype=float)
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


CASES = {
    "random": random_symmetric(1, 40),
    "one": np.array([[3.0]]),
    "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    "identity": np.eye(12),
    "zero": np.zeros((5, 5)),
    "diagonal": np.diag([5.0, 1.0, 1.0, 3.0, 0.0, -2.0]),
    "tridiagonal": np.diag(np.arange(1.0, 21)) + np.diag(np.ones(19), 1) + np.diag(np.ones(19), -1),
    "repeated": random_symmetric(2, 30, [7.0] * 10 + [3.0] * 10 + [0.0] * 10),
    "clustered": random_symmetric(3, 64, 1 + 1e-10 * np.arange(64)),
    "graded": random_symmetric(4, 24, 10.0 ** -np.arange(24)),
    "wilkinson": np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    "large": random_symmetric(5, 30) * 1e120,
    "small": random_symmetric(6, 30) * 1e-120,
    "blocks": np.kron(np.eye(6), random_symmetric(7, 4)),
}


@pytest.mark.parametrize("name", CASES)
def test_tridiagonal(name):
    a = CASES[name]
    diagonal, off, q = w.tridiagonal(a)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(q @ q.T, np.eye(len(a)), atol=1e-13)
    assert np.max(np.abs(q @ t @ q.T - a)) <= 1e-13 * max(np.max(np.abs(a)), 1e-300) * len(a)


@pytest.mark.parametrize("name", CASES)
def test_components(name):
    a = CASES[name]
    size, scale = len(a), max(np.linalg.norm(a, 2), 1e-300)
    want = np.linalg.eigvalsh(a)[::-1]
    for most in (1, 5, size):
        values, vectors = w.leading_components(a, most)
        k = min(most, size)
        assert np.max(np.abs(values - want[:k])) <= 1e-14 * scale * size
        assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
        assert np.max(np.abs(vectors @ a - values[:, None] * vectors)) <= 1e-13 * scale * size


def test_sturm_counts():
    diagonal, off, _ = w.tridiagonal(CASES["random"])
    values = np.linalg.eigvalsh(CASES["random"])
    at = np.concatenate([(values[1:] + values[:-1]) / 2, [-100, 100]])
    assert w.sturm_counts(diagonal, off, at).tolist() == [int((values < x).sum()) for x in at]


def rows_from(seed, n, size, spread=1.0):
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(size)]
    found = []
    for i in range(n):
        z = [rng.gauss(0, spread / (1 + k)) for k in range(size)]
        found.append((i, [sum(z[k] * mix[k][j] for k in range(size)) for j in range(size)]))
    return found


def check(spark, rows, kept, most):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = w.whiten(df, most=most).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * e - s) ** 2 for e, s in zip(row, sums)) for row in x]
    moved = np.array([[(n * e - s) / n for e, s in zip(row, sums)] for row in x])
    matrix = moved.T @ moved / n
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = min(most, int((values > len(values) * 2.2e-16 * values.sum()).sum()))
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-9
    assert sorted(by) == list(range(1, k + 1))
    for component, found in by.items():
        white = moved @ vectors[component - 1] / math.sqrt(values[component - 1])
        want = sorted((str(i), d, y) for (i, _), d, y in zip(kept, deviation, white))
        have = sorted((str(r.vec_id), int(r.deviation), r.whitened) for r in found)
        assert [x[:2] for x in want] == [x[:2] for x in have]
        dot = np.dot([x[2] for x in want], [x[2] for x in have]) / n
        assert abs(abs(dot) - 1) < 1e-9  # either sign


def test_whiten(spark):
    rows = rows_from(1, 200, 10)
    check(spark, rows, rows, 4)
    check(spark, rows, rows, 32)


def test_awkward_vectors(spark):
    rows = rows_from(2, 60, 6)
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [None] + [1.0] * 5), (904, [math.nan] * 6), (905, [math.inf] + [0.0] * 5), (906, [1.0] * 7)]
    nameless = [(None, [0.5, -0.5, 0.25, 0.0, -0.0, 1.0])]
    check(spark, rows + odd + rows[:3] + nameless, rows + rows[:3] + nameless, 6)


def test_far_from_zero_and_exact_beyond_a_long(spark):
    rows = [(i, [1e6 + e * 1e5 for e in v]) for i, v in rows_from(3, 50, 4)]
    check(spark, rows, rows, 4)
    huge = [(i, [e * 1e9 for e in v]) for i, v in rows_from(4, 40, 3)]
    df = spark.createDataFrame(huge, "vec_id bigint, embedding array<double>")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in huge]
    sums = [sum(col) for col in zip(*x)]
    want = {i: sum((40 * e - s) ** 2 for e, s in zip(row, sums)) for i, row in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in w.whiten(df).collect()} == want


def test_nothing_varies(spark):
    schema = "vec_id bigint, embedding array<double>, x string, component string"
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [0.5, 0.5], "", "")], [(i, [0.5, 0.5], "", "") for i in range(9)], [(1, None, "", "")], [(1, [], "", "")]):
        got = w.whiten(spark.createDataFrame(rows, schema))
        assert got.columns == columns and got.count() == 0
    # one direction does not vary: it is no component
    got = w.whiten(spark.createDataFrame([(i, [float(i), 1.0, float(-i)], "", "") for i in range(9)], schema)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_an_entry_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="an entry of"):
        w.whiten(df).collect()


def test_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, f"{DATA}/sf0.01", "embeddings").collect()]
    got = QUERIES["op12_whitening"](spark, f"{DATA}/sf0.01").toPandas()
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float64)) + 1_000_000
    moved = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(moved.T @ moved / len(x))
    assert len(got) == len(x) * 32 and got.identity_error.max() < 1e-10
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    want = moved @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    signs = np.sign((wide * want).sum(axis=0))
    assert np.max(np.abs(wide * signs - want)) < 1e-8
