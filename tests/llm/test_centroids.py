"""Clusters against plain rounds in Python; bounds of the projection; odd rows."""

from hashlib import sha256

import numpy as np
import pytest

from threadloom.llm import centroids


def plain(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])) + sorted((r for r in kept if r[0] is None), key=lambda r: r[1])
    cs = [v for _, v in order[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((d2(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cs)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    by = {}
    for _, j, s in out:
        by[j] = by.get(j, 0) + s
    return sorted(((i, j, s, by[j], sum(by.values()), sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, s in out), key=str)


def vectors(seed, n, dim):
    r = np.random.default_rng(seed)
    mid = r.normal(0, 2, (7, dim))
    return [(i, [float(np.float32(x)) for x in mid[i % 7] + r.normal(0, 0.7, dim)]) for i in range(n)]


@pytest.mark.parametrize("k,dim,rounds", [(9, 6, 5), (30, 5, 3), (4, 1, 5), (200, 3, 2)])
def test_equals_plain_rounds(spark, k, dim, rounds):
    rows = vectors(k, 150, dim)
    rows += [(3, rows[3][1]), (500, rows[4][1]), (501, rows[4][1]), (502, rows[4][1]), (None, rows[5][1]), (503, [0.0] * dim), (504, [-0.0] * dim)]
    rows += [(600, None), (601, []), (602, [1.0] * (dim + 1)), (603, [None] + [1.0] * (dim - 1)), (604, [float("nan")] * dim), (605, [float("inf")] * dim), (606, [float("-inf")] + [0.0] * (dim - 1))]
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], "vec_id long, embedding array<float>, v string, apex string").repartition(5)
    got = centroids.cluster(df, k=k, rounds=rounds, dim=dim, pivots=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, k, rounds, dim)


def test_empty_and_all_alike(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).collect() == []
    alike = spark.createDataFrame([(i, [1.5, -2.25]) for i in range(50)], "vec_id long, embedding array<double>")
    got = centroids.cluster(alike, k=6, dim=2).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)} and len(got) == 50


def test_bounds_hold_and_filter():
    r = np.random.default_rng(1)
    v = r.integers(-600, 600, (400, 16))
    v = np.concatenate([v, v[:40] + r.integers(-3, 4, (40, 16))])
    cs = v[-40:]
    simplex = centroids.Simplex(centroids.choose_pivots(cs, 8))
    x, y, true = simplex.apexes(v), simplex.apexes(cs), centroids.squared(v, cs)
    flat = ((x[:, None, :-1] - y[None, :, :-1]) ** 2).sum(2)
    low, high = flat + (x[:, None, -1] - y[None, :, -1]) ** 2, flat + (x[:, None, -1] + y[None, :, -1]) ** 2
    assert (low <= true + 1e-3).all() and (high >= true - 1e-3).all()
    which, d2, compared = centroids.nearest(v, x, cs, y)
    assert (which == true.argmin(1)).all() and (d2 == true.min(1)).all() and compared < 0.9 * true.size


def test_large_components_are_exact():
    v = np.array([[centroids.LARGEST - 1] * 4, [1 - centroids.LARGEST] * 4, [centroids.LARGEST - 2] * 4])
    assert centroids.squared(v, v)[0].tolist() == [0, 4 * (2 * centroids.LARGEST - 2) ** 2, 4]
