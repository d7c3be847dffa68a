"""Connected components of an edge table by alternating large-star and small-star.

Every step is a join of the edges with one minimum per node, so a hub with a
third of all edges is combined map-side and split by adaptive skew joins; no
neighbour list is ever gathered.  Edges and labels stay distributed; the
driver sees one row per round: whether the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist_shared


def _both_ways(e: DataFrame) -> DataFrame:
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    return e.select(F.inline(F.array(there, back)))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both_ways(e)
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # edges run from the larger node u to the smaller node v; the one to the smallest links u itself
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                   F.col("m").alias("v")).distinct()


def _are_stars(e: DataFrame) -> bool:
    """Whether every node that has a smaller neighbour has no other: no round would change an edge."""
    seen = _both_ways(e).groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))
    return not seen.agg(F.coalesce(F.max((F.col("m") < F.col("u")) & (F.col("m") < F.col("x"))), F.lit(False))).first()[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label the nodes of ``edges`` (long columns) with the smallest node they reach.

    Returns (node, root) for every node that has an edge to another node, the
    root itself included.  Null ends, loops and repeated edges are ignored; no
    edges give an empty result.
    """
    a, b = F.col(a), F.col(b)
    e = persist_shared(edges.where(a.isNotNull() & b.isNotNull() & (a != b))
                       .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _are_stars(e):
        e = persist_shared(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
