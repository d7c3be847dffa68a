"""MinHash near-duplicate documents (operator 8).

Many universal hash minima with banding find candidates, signatures and then
full shingle sets verify them, and alternating large-star / small-star gives
the components.

Copies with equal shingle sets fold into one class before anything is
compared (a map-side combined grouping), so thousands of copies cost one row.
The shingle sets themselves are never stored for the whole corpus: the scan
keeps bands and one signature byte per minimum, and only documents that
survive the signature check are read again for their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persist_shared, small_batches, table
from .components import connected_components
from .lsh import band_hashes, exact_links, hash_family, minima, rows_with_ids, tune, verified_members
from .textops import fmix, shingle_hashes, slices, to_batch, word_bounds, word_hashes


def _document_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for s in slices(column):
        starts, ends, first = word_bounds(s)
        h, at = shingle_hashes(word_hashes(s, starts, ends), first, words)
        for i in range(s.n):
            yield np.unique(h[at[i]:at[i + 1]])


SCAN = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()),
                  ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
SCAN_DDL = "doc_id long, n int, f1 long, f2 long, bands array<long>, sig binary"


def _scan(words: int, bands: int, rows: int):
    a, b = hash_family(bands * rows)

    def run(batches):
        for batch in batches:
            n, f1, f2, buckets, sigs = [], [], [], [], []
            for s in _document_sets(batch.column("text"), words):
                n.append(len(s))
                if len(s):
                    sig = minima(s, a, b)
                    f1.append(int(s.sum().view(np.int64)))
                    f2.append(int(fmix(s).sum().view(np.int64)))
                    buckets.append(band_hashes(sig, bands, rows))
                    sigs.append((sig & 255).astype(np.uint8).tobytes())
                else:
                    f1.append(0), f2.append(0), buckets.append([]), sigs.append(b"")
            yield to_batch(SCAN, [batch.column("doc_id"), n, f1, f2, buckets, sigs])
    return run


SETS = pa.schema([("id", pa.int64()), ("set", pa.binary())])


def _sets_of(words: int):
    def run(batches):
        for batch in batches:
            yield to_batch(SETS, [batch.column("doc_id"), [s.tobytes() for s in _document_sets(batch.column("text"), words)]])
    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, group_rows: int = 4096,
                    chunk_shingles: int = 1_000_000) -> DataFrame:
    """Components of documents whose ``words``-word shingle sets have Jaccard >= percent/100.

    ``docs`` has doc_id long and text (other columns are ignored).  Returns
    one row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable, itself included), kept (doc_id = component_id).

    Defined cases: null and empty texts have no shingles and link with
    nothing; texts of fewer than ``words`` words have one shingle, the whole
    sequence; a row without doc_id links with nothing and has a null
    component and kept = true; repeated rows are equal sets and fall into one
    class; the same id on different texts gives a row per text, and an id
    that represents both joins them; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = tune(percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = persist_shared(docs.mapInArrow(_scan(words, bands, rows), SCAN_DDL))
    key = ["n", "f1", "f2"]
    classes = persist_shared(scan.where("n > 0 and doc_id is not null").groupBy(*key).agg(
        F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig")))

    def fetch(ids: DataFrame) -> DataFrame:
        found = rows_with_ids(docs, ids.withColumnRenamed("id", "doc_id"), "doc_id")
        return persist_shared(found.mapInArrow(_sets_of(words), "id long, set binary"))

    members = verified_members(classes.select("id", "n", "bands", "sig"), percent, bands * rows, group_rows)
    comp = connected_components(exact_links(members, fetch, percent, chunk_shingles))
    named = classes.select(*key, "id").join(comp.withColumnRenamed("node", "id"), "id", "left") \
        .select(*key, F.coalesce("root", "id").alias("root"))
    out = scan.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.cast("long").alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents: 3-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=85)
