"""Centroid clustering by scalar lookup tables (operator 12).

Vectors become small whole numbers, so a component takes few different values.
In every round a task tabulates, for each dimension, the squared difference of
each occurring value and each centroid; a distance is then a sum of gathers
from these tables, in whole numbers throughout.

Scale: the whole-number vectors are written once and scanned once a round.  A
task holds the tables of one batch of rows and one sum for each centroid and
dimension; those sums are combined map-side and by a shuffle, so what the
driver receives in a round is ``k * dim`` rows whatever the table's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, write_shared
from .textops import to_batch

BATCH = 4096  # rows whose tables and distances a task holds at a time
EXACT = "decimal(38,0)"


def whole_numbers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v array<int>) of the vectors of exactly ``dim`` finite components: floor(scale * x).

    A component so large that a squared distance could leave the long range is an error.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # dim * (2 * limit)^2 < 2^63, and a component fits an int
    limit = min(1 << 30, int((2.0 ** 61 / dim) ** 0.5) - 1)
    whole = vectors.where(F.size("embedding") == dim).where(finite) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(scale * c)).alias("v"))
    fits = F.forall("v", lambda c: c.between(-limit, limit))
    return whole.select("vec_id", F.when(fits, F.col("v")).otherwise(
        F.raise_error(F.lit(f"a component is beyond {limit} after scaling"))).cast("array<int>").alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``seed:vec_id``, in that order (fewer, if the table has fewer).

    Rows of one id are ordered by their vectors; rows without id come last.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _codes(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The occurring values in ascending order, and each entry's place among them."""
    low, high = int(column.min()), int(column.max())
    if high - low > 4 * len(column):
        return np.unique(column, return_inverse=True)
    seen = np.zeros(high - low + 1, np.int32)
    seen[column - low] = 1
    return np.flatnonzero(seen) + low, (np.cumsum(seen, dtype=np.int32) - 1)[column - low]


def _pieces(batches, dim: int):
    """(ids, components by dimension) of at most ``BATCH`` rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            yield part.column(0), np.ascontiguousarray(
                part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).T).astype(np.int64)


def nearest_centroid(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Number and squared distance of each row's nearest centroid (ties: the smaller number),
    and the codes of every dimension.  ``values`` has one row for each dimension."""
    total = np.zeros((values.shape[1], len(centroids)), np.int64)
    coded = []
    for d, column in enumerate(values):
        occurring, code = _codes(column)
        squares = (occurring[:, None] - centroids[None, :, d]) ** 2  # the dimension's table
        total += squares[code]
        coded.append((occurring, code))
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best], coded


def _sums(centroids: np.ndarray):
    """Per task: count and component sums of every centroid's rows."""
    k, dim = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, values in _pieces(batches, dim):
            best, _, coded = nearest_centroid(values, centroids)
            count += np.bincount(best, minlength=k)
            for d, (occurring, code) in enumerate(coded):
                m = len(occurring)
                sums[:, d] += np.bincount(best * m + code, minlength=k * m).reshape(k, m) @ occurring
        c, d = np.divmod(np.arange(k * dim), dim)
        some = count[c] > 0
        yield to_batch(schema, [c[some], d[some], count[c[some]], sums.ravel()[some]])
    return run


def _assign(centroids: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for ids, values in _pieces(batches, centroids.shape[1]):
            best, distance, _ = nearest_centroid(values, centroids)
            yield to_batch(schema, [ids, best, distance])
    return run


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of every non-empty centroid's mean; empty ones stay."""
    parts = whole.mapInArrow(_sums(centroids), "cluster int, dim int, n long, total long")
    rows = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast(EXACT)).alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in rows:  # at most k * dim rows
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: str = "2") -> DataFrame:
    """Assign every vector to one of ``k`` centroids after ``rounds`` rounds.

    ``vectors`` has vec_id and embedding (other columns are ignored).  Returns
    vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Defined cases: vectors that are null, of another length, or hold null or
    non-finite components take no part; a null vec_id is assigned like any
    other, but only starts a centroid when the ids do not suffice; repeated
    rows count each and each may start a centroid (equal centroids: the
    smaller number wins, the other stays empty where it is); fewer vectors
    than ``k`` give as many centroids; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    whole = write_shared(whole_numbers(vectors, dim, scale), "whole-vectors")
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    assigned = write_shared(whole.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.s) for r in
            assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(EXACT)).alias("s")).collect()}  # at most k rows
    about = {c: (s, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()}

    def by_cluster(i: int, kind: str) -> Column:
        pairs = [F.lit(x) for c, v in sorted(about.items()) for x in (c, v[i])]
        return F.create_map(*pairs)[F.col("cluster")].cast(kind)
    return assigned.select("vec_id", "cluster", "distance", by_cluster(0, "long").alias("cluster_inertia"),
                           F.lit(sum(sums.values())).cast("long").alias("inertia"), by_cluster(1, "string").alias("centroid_sha256"))


def op12_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: 40 centroids, five rounds, over all embeddings."""
    return cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The same rounds as relational steps: one row for each vector and dimension."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (SELECT r, c, sum((e.x - k.x) * (e.x - k.x)) AS dist FROM e JOIN k{i} k USING (d) GROUP BY r, c),
a{i} AS MATERIALIZED (SELECT r, arg_min(c, dist * 1000 + c) AS c, min(dist) AS dist FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN e USING (r) GROUP BY c, d),
k{i + 1} AS MATERIALIZED (SELECT k.c, k.d,
  coalesce((s - ((s % n) + n) % n) // n, k.x) AS x FROM k{i} k LEFT JOIN m{i} m ON m.c = k.c AND m.d = k.d)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS z
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT r, unnest(z) AS x, unnest(range(1, 65)) AS d FROM v),
s AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, z) - 1 AS c, z FROM v
  ORDER BY sha256('2:' || vec_id) NULLS LAST, z LIMIT {k}),
k0 AS MATERIALIZED (SELECT c, unnest(z) AS x, unnest(range(1, 65)) AS d FROM s),{",".join(steps)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS hash FROM k{rounds} GROUP BY c),
t AS (SELECT c, sum(dist)::BIGINT AS inertia FROM a{rounds} GROUP BY c)
SELECT v.vec_id, a.c::INTEGER AS cluster, a.dist::BIGINT AS distance, t.inertia AS cluster_inertia,
       (SELECT sum(inertia) FROM t)::BIGINT AS inertia, h.hash AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN h USING (c) JOIN t USING (c)
"""


OP12_SQL = _sql()
