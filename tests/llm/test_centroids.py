"""Operator 12 against a plain Python version in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from souq.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def brute(rows, k, rounds, scale, dim):
    """(vec_id, cluster, distance, cluster inertia, inertia, hash) rows of the definition, in Python integers."""
    kept = [(i, [math.floor(scale * c) for c in e]) for i, e in rows
            if e is not None and len(e) == dim and all(c is not None and math.isfinite(c) for c in e)]

    def start(r):
        return (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cent = [v for _, v in sorted(kept, key=start)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cent)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for n in range(len(cent)):
            mine = [v for (_, v), (_, m) in zip(kept, at) if m == n]
            if mine:
                cent[n] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    total = sum(d for d, _ in at)
    return sorted((repr(i), n, d, sum(e for e, m in at if m == n), total, hashlib.sha256(",".join(map(str, cent[n])).encode()).hexdigest())
                  for (i, _), (d, n) in zip(kept, at))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA).repartition(3)
    return sorted((repr(r[0]), *r[1:]) for r in map(tuple, C.cluster(df, **kw).collect()))


def test_random_and_repeated_vectors(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(300, 8))
    x[100:200] = x[100]  # a third of all rows are one vector
    rows = [(i if i < 250 else i - 50, v.tolist()) for i, v in enumerate(x)]  # some ids twice
    for k, rounds in ((1, 0), (7, 3), (40, 5), (400, 2)):
        assert run(spark, rows, k=k, rounds=rounds, scale=16, dim=8) == brute(rows, k, rounds, 16, 8)


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, 0.5]), (0, [1.0, 0.0]),
            (0, [-1.0, -0.001]), (9, []), (None, None)]
    for k in (1, 3, 40):
        assert run(spark, rows, k=k, rounds=3, scale=256, dim=2) == brute(rows, k, 3, 256, 2)
    assert run(spark, [(2, None)], dim=2) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert C.cluster(empty).count() == 0 and C.cluster(empty).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_wide_and_too_large_components(spark):
    rows = [(i, [float(i * i * 1000), -float(i)]) for i in range(60)]  # more values than a counting table takes
    assert run(spark, rows, k=5, rounds=4, scale=256, dim=2) == brute(rows, 5, 4, 256, 2)
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e300, 0.0])], dim=2)


def test_tables_give_squared_distances():
    g = np.random.default_rng(2)
    v, c = g.integers(-50, 50, (3, 100)), g.integers(-50, 50, (4, 3))
    v[0, :50] = 1 << 27  # a span that is tabulated by sorting
    best, distance, _ = C.nearest_centroid(v, c)
    full = ((v.T[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
