"""Approximate nearest neighbours by a permutation index (operator 5).

Every vector is represented by the order of its nearest pivots (a prefix of
the permutation).  The prefix is posted into one inverted file per pivot.  A
query accumulates the footrule distance to all rows that share pivots with it
through those files, the closest rows are reranked by the exact inner product.

Scale: the rows are dealt into blocks of bounded size, each with its own
inverted files, and the queries into blocks too; one task holds one block of
each.  Only the best k of every block and query are shuffled, and merging
them is a top-k window with a limit before its shuffle.  No pair is emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import persist_shared, table
from .textops import to_batch


def usable(v: str = "embedding"):
    """Whether a vector has no null or non-finite component and is not zero or null."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def choose_pivots(vectors: DataFrame, pivots: int, sample: int = 2048, apart: float = 0.8) -> np.ndarray:
    """Unit pivots out of a bounded sample: the ``sample`` rows with the smallest id hash.

    One heap per task and one merge; the sample does not depend on the layout.
    Rows are taken in hash order unless their cosine with a pivot already
    taken exceeds ``apart``: a group of near copies would otherwise fill the
    permutations with pivots that say the same.
    """
    rows = vectors.select(F.xxhash64("vec_id", "embedding").alias("h"), "embedding").orderBy("h").limit(sample).collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    chosen: list[int] = []
    for i in range(len(v)):
        if len(chosen) < pivots and (not chosen or (v[chosen] @ v[i]).max() <= apart):
            chosen.append(i)
    return v[chosen]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _permute(pivots: np.ndarray, prefix: int):
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("perm", pa.binary())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(pa.chunked_array([b.column("embedding")]), pivots.shape[1])
            near = -(v @ pivots.T)
            # equal distances are ordered by the pivot's number
            perm = np.argsort(near, axis=1, kind="stable")[:, :prefix].astype(np.uint16)
            yield to_batch(schema, [b.column("vec_id"), b.column("embedding"), [x.tobytes() for x in perm]])
    return run


def _search(pivots: int, dim: int, k: int, share: float, least: int):
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows, queries):
        out: list[list] = [[], [], [], []]
        n = rows.num_rows
        if n and queries.num_rows:
            ids, v = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding"), dim)
            perm = np.frombuffer(b"".join(rows.column("perm").to_pylist()), np.uint16).reshape(n, -1)
            size = perm.shape[1]
            # inverted files: the rows of each pivot, and size - position of the pivot in the row's order
            order = np.argsort(perm, axis=None, kind="stable")
            begin = np.searchsorted(perm.ravel()[order], np.arange(pivots + 1))
            member, gain = order // size, (size - order % size).astype(np.float64)
            qperm = np.frombuffer(b"".join(queries.column("perm").to_pylist()), np.uint16).reshape(queries.num_rows, -1)
            qv = _matrix(queries.column("embedding"), dim)
            full = size * (size + 1) / 2
            take = min(n, max(math.ceil(share * n), least))
            for i, (qid, q) in enumerate(zip(queries.column("query_id").to_pylist(), queries.column("q").to_pylist())):
                # footrule with absent pivots at position size: size * (size + 1) - 2 * sum of
                # (size - larger position) over shared pivots; closest = largest sum
                near = [(begin[p], begin[p + 1], size - j) for j, p in enumerate(qperm[i].tolist())]
                near_rows = np.concatenate([member[a:b] for a, b, _ in near])
                agree = np.bincount(near_rows, np.concatenate([np.minimum(gain[a:b], w) for a, b, w in near]), n)
                # ties with the last one taken and everything in nearly the same order come along
                cut = min(np.partition(agree, n - take)[n - take], full / 2)
                c = np.flatnonzero((agree >= cut) & (ids != qid))
                s = v[c] @ qv[i]
                if len(c) > k:
                    c = c[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9 * max(1.0, float(np.abs(s).max()))]
                s = (v[c] * qv[i]).sum(axis=1)
                best = np.lexsort((ids[c], -s))[:k]
                out[0] += [qid] * len(best)
                out[1] += [q] * len(best)
                out[2] += ids[c[best]].tolist()
                out[3] += s[best].tolist()
        return pa.Table.from_batches([to_batch(schema, out)])
    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, pivots: int = 256, prefix: int = 64, share: float = 0.12,
            least: int = 1000, block_rows: int = 16_384, query_rows: int = 1024) -> DataFrame:
    """The k rows of largest inner product for every query row, by the permutation index.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on
    vec_id.  The pivots are fitted on a bounded sample
    (``choose_pivots``); every row is indexed.  Per block and query, the ``share`` of rows with the smallest
    footrule (at least ``least``) are reranked, together with all that tie
    with the last of them or lie within half of the largest footrule, so a
    large group of near copies is always compared whole.

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id.

    Defined cases: rows with null vec_id, or a vector that is null, zero,
    holds null or non-finite components, or has another length than most,
    take no part.  Rows with the query's vec_id are its own and no candidates.
    A repeated row is a further candidate with the same id; a repeated query
    row asks once.  An empty table, or one with no query, gives an empty result.
    """
    spark = vectors.sparkSession
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .where(F.col("vec_id").isNotNull()).where(usable())
    lengths = ok.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].d
    ok = ok.where(F.size("embedding") == dim)
    p = choose_pivots(ok, pivots)
    index = persist_shared(ok.mapInArrow(_permute(p, min(prefix, len(p))), "vec_id long, embedding array<double>, perm binary"))
    queries = index.where(is_query).groupBy(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("q")) \
        .agg(F.any_value("embedding").alias("embedding"), F.any_value("perm").alias("perm"))
    n, nq = index.count(), queries.count()
    blocks, qblocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(nq / query_rows))
    left = index.withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks))) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(qblocks)).cast("int")) \
        .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(
        _search(len(p), dim, k, share, least), "query_id long, q long, vec_id long, score double")
    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: every row whose id is divisible by 20 against all rows."""
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)
