import numpy as np
from pyspark.sql import functions as F

from souq.llm import permutation_index as P


def exact(x, ids, q, k):
    s = (x * x[q]).sum(axis=1)
    keep = np.flatnonzero(ids != ids[q])
    order = keep[np.lexsort((ids[keep], -s[keep]))[:k]]
    return [(int(ids[j]), float(s[j])) for j in order]


def run(spark, x, ids, **kw):
    df = spark.createDataFrame([(int(i), [float(c) for c in v], 1, 2.0) for i, v in zip(ids, x)],
                               "vec_id long, embedding array<double>, rank int, score double")
    out = {}
    for r in P.nearest(df, F.col("vec_id") % 20 == 0, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_on_random_and_clustered_vectors(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(3000, 24))
    x[1000:2000] = x[1000] + 0.01 * g.normal(size=(1000, 24))  # a third are near copies
    ids = np.arange(3000)
    got = run(spark, x, ids, least=100, share=0.15, block_rows=800, query_rows=60)
    hit = total = 0
    for q in range(0, 3000, 20):
        want = exact(x, ids, q, 20)
        assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hit += len({v for v, _ in want} & {v for v, _ in got[q]})
        total += 20
    assert hit / total >= 0.9


def test_ties_and_small_tables_are_exact(spark):
    x = np.repeat(np.eye(4), 15, axis=0)
    ids = np.arange(60)
    assert run(spark, x, ids) == {q: exact(x, ids, q, 20) for q in range(0, 60, 20)}


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, 0.5]), (20, [0.0, 0.0]), (40, []), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in P.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 8, 0.5)]
    assert P.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
