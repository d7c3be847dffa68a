"""Folds, bounded labelled samples and per-text scoring shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id's text falls into the held-out fold; null ids do not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text) of at most ``per_class`` labelled ids of each class, outside the held-out
    fold, chosen by id hash; and how many labelled ids each class has in all.

    Rows with a null id or a label other than 0 and 1 are ignored; an id with
    both labels keeps the smaller; ids without a document give no row; of
    different texts of an id the one with the smallest hash is taken.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.min(label).alias("y"))
    counts = {r.y: r.n for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in sorted(counts)]
    if not picks:
        return docs.select("doc_id", F.lit(0).alias("y"), "text").limit(0), counts
    chosen = picks[0]
    for p in picks[1:]:
        chosen = chosen.union(p)
    # one text of each id, combined map-side: bounded by 2 * per_class rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y") \
        .agg(F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"))).alias("text")), counts


def collect_features(sample: DataFrame, features: Callable[[pa.Array], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows (float32) and labels of a bounded sample, in id order.

    Only what is not zero is sent: each row's positions, then its values.
    """
    def run(batches):
        for b in batches:
            sent = []
            for r in features(b.column("text")):
                at = np.flatnonzero(r)
                sent.append(at.astype(np.uint32).tobytes() + r[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(sent, pa.binary())], ["doc_id", "y", "x"])
    small_batches(sample.sparkSession)
    t = sample.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text") \
        .mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    if not t.num_rows:
        return np.zeros((0, 1), np.float32), np.zeros(0, np.int64)
    x = np.zeros((t.num_rows, features(pa.array([""])).shape[1]), np.float32)
    for i, r in enumerate(t.column("x")):
        at, values = np.split(np.frombuffer(r.as_py(), np.uint32), 2)
        x[i, at] = values.view(np.float32)
    return x, t.column("y").to_numpy().astype(np.int64)


def with_score(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its ``text`` column, computed batch by batch."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b.column(at)), pa.float64())],
                                             [*b.schema.names, name])
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)
