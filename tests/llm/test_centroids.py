"""Clustering against rounds computed in plain Python, and bounds against distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from logtel.llm import centroids as c

SMALL = c.Clustering(dimensions=8, centroids=5, rounds=3, seed=1, leading=3)
FIELDS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute_force(rows, spec):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == spec.dimensions and all(e is not None and math.isfinite(e) for e in v):
            kept.append((vec_id, [math.floor(64 * e) for e in v]))
    named = sorted((hashlib.sha256(f"{spec.seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centres = [x for _, x in named[: spec.centroids]]

    def place(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, m)), k) for k, m in enumerate(centres))

    for _ in range(spec.rounds):
        own = [[] for _ in centres]
        for _, x in kept:
            own[place(x)[1]].append(x)
        centres = [[sum(col) // len(xs) for col in zip(*xs)] if xs else m for xs, m in zip(own, centres)]
    found = [(i, *reversed(place(x))) for i, x in kept]
    sums = {k: sum(d for _, j, d in found if j == k) for k in range(len(centres))}
    return sorted(((i, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, d in found), key=repr)


def vectors(seed, n, spec, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.uniform(-spread, spread) for _ in range(spec.dimensions)] for _ in range(4)]
    return [(i, [rng.gauss(m, 0.2) for m in middles[i % 4]]) for i in range(n)]


def check(spark, rows, spec=SMALL, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(4)
    got = sorted((tuple(r) for r in c.cluster(df, spec).select(FIELDS).collect()), key=repr)
    assert got == brute_force(rows, spec)


def test_rounds(spark):
    check(spark, vectors(1, 300, SMALL))


def test_awkward_vectors(spark):
    good = vectors(2, 40, SMALL)
    same = [0.5] * 8
    rows = [
        *good, *good[:5], (900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [None] + [1.0] * 7), (905, [math.nan] + [1.0] * 7),
        (906, [math.inf] + [1.0] * 7), (907, [-math.inf] + [1.0] * 7), (None, same), (None, [-e for e in same]), (908, [0.0] * 8), (909, [-0.0] * 8),
        (910, [20000.0] * 8), (910, [-20000.0] * 8), (910, [-20000.0] * 8),
    ]
    check(spark, rows)


def test_ties_and_copies(spark):
    # whole coordinates, so that many vectors are as far from two centroids
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(8)]) for i in range(120)]
    check(spark, rows)
    check(spark, [(i, [0.25] * 8) for i in range(30)])


def test_fewer_vectors_than_centroids(spark):
    check(spark, vectors(4, 3, SMALL))
    check(spark, [(7, [0.1] * 8)])


def test_no_vectors_and_clashing_columns(spark):
    schema = "vec_id int, embedding array<float>, id string, x string, cluster string, distance string, leading string"
    assert c.cluster(spark.createDataFrame([], schema), SMALL).count() == 0
    rows = [(i, v, "own", "own", "own", "own", "own") for i, v in vectors(5, 20, SMALL)]
    got = c.cluster(spark.createDataFrame(rows, schema), SMALL)
    assert got.columns == [*FIELDS, "compared"] and got.count() == 20


def test_a_component_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [3e6] * 8)], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="a component of"):
        c.cluster(df, SMALL).collect()


@pytest.mark.parametrize("leading", [1, 3, 8])
def test_bounds_never_exceed_distances(leading):
    rng = np.random.default_rng(leading)
    x = rng.integers(-5000, 5000, (400, 8))
    x[:50] = x[0]
    axes = np.linalg.qr(rng.standard_normal((8, 8)))[0][:leading]
    turn = c.Rotation(x.mean(axis=0), axes)
    centres = np.concatenate([x[:10], rng.integers(-(1 << 27), 1 << 27, (6, 8))])
    lower = c.bounds(*turn.project(x), *turn.project(centres))
    exact = ((x[:, None, :].astype(object) - centres[None].astype(object)) ** 2).sum(axis=2)
    assert np.all(lower <= exact.astype(np.float64))
    chosen, least, compared = c.nearest(x, lower, centres)
    for i in range(len(x)):
        assert (least[i], chosen[i]) == min((d, k) for k, d in enumerate(exact[i]))
    assert np.all(compared >= 1)


def test_bounds_leave_most_centroids_out(spark):
    spec = c.Clustering(dimensions=32, centroids=16, leading=8)
    rng = random.Random(6)
    middles = [[rng.uniform(-1, 1) for _ in range(32)] for _ in range(16)]
    rows = [(i, [rng.gauss(m, 0.05) for m in middles[i % 16]]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    compared = [r.compared for r in c.cluster(df, spec).select("compared").collect()]
    assert sum(compared) / len(compared) < 4
