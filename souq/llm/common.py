"""Readers and lineage helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage, remove_at_exit, shuffles_end_with_actions

# Rows per Arrow batch of the Python stages: texts can be long, so batches are
# kept small enough for a worker to hold several of them.
TEXT_ROWS_PER_BATCH = 512

# Largest number of rows (of a few longs each) that is broadcast on purpose.
# Every use counts the rows first and has a shuffle join beyond the bound.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table (a missing table or column is an error)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python stages planned from now on receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))


def persist_shared(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder and cut the lineage there.

    A lost executor re-reads the files; Spark's context cleaner removes them
    when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    return cut_lineage(df)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into a new folder under ``spark.checkpoint.dir`` and read it back.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    with shuffles_end_with_actions(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the (materialised) frame has at most ``bound`` rows."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def fresh_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until they clash with none of ``columns``."""
    lower, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in lower:
            name += "_"
        lower.add(name.lower())
        out.append(name)
    return out


def numbered_texts(docs: DataFrame, name: str) -> DataFrame:
    """Add ``name``: a long that stands for one text.

    It is the doc_id where that names one text only.  Where rows of one id
    have different texts, each text of it gets a number of its own beyond all ids,
    from a hash of id and text; null ids stay null.  Equal rows stay equal.
    """
    one, two = fresh_names(docs.columns, "__text", "__several")
    hashed = docs.withColumn(one, F.xxhash64("text"))
    doc = F.col("doc_id").cast("long")
    several = persist_shared(hashed.where("doc_id is not null").groupBy(doc.alias("id"))
                             .agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("id"))
    n = several.count()
    if not n:
        return docs.withColumn(name, doc)
    marked = hashed.join(checked_broadcast(several.select(F.col("id").alias(two)), n), doc == F.col(two), "left")
    for salt in range(64):
        number = F.shiftrightunsigned(F.xxhash64(F.col(two), F.col(one), F.lit(salt)), 2).bitwiseOR(F.lit(1 << 62))
        given = persist_shared(marked.where(F.col(two).isNotNull()).select(two, one, number.alias("number")).distinct())
        taken = docs.select(doc.alias("number")).join(given.select("number"), "number", "left_semi").isEmpty()
        if taken and given.count() == given.select("number").distinct().count():
            return marked.withColumn(name, F.when(F.col(two).isNotNull(), number).otherwise(doc)).drop(one, two)
    raise RuntimeError("no free numbers for texts that share ids")

