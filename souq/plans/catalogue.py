"""Warehouse tables in the catalogue, the facts bucketed on order_id.

Stored sales and stored orders are hashed into the same number of buckets by
``order_id`` when they are written, so joining or grouping them by order needs
no shuffle.  The data lies in plain folders that a
:class:`~souq.sources.stored.Load` exchanges, so a build is whole or not at
all; the catalogue holds definitions over them.  How many buckets the files
have is written beside them and travels with them, so a definition never
disagrees with its files.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import DEC_SUM
from ..session import setting
from ..sources.sinks import WAREHOUSE_SCHEMAS, conform
from ..sources.stored import Files, Load, recover
from .build import FACTS
from .star import Star

BUCKET_KEY = "order_id"
_MARK = "_buckets_"

#: lines that a task sorts and writes to a bucket
ROWS_PER_BUCKET = 1_000_000


def _database(spark: SparkSession, base: str, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{base}/_database'")


def _stage_bucketed(load: Load, name: str, df: DataFrame, buckets: int, database: str) -> None:
    """Write a table as ``buckets`` sorted files by ``BUCKET_KEY`` into the load's staging folder."""
    path = load.place(name)
    temporary = f"`{database}`.staged_{uuid.uuid4().hex}"  # bucketed files are only written through a table
    # joins by the key make as many parts as there are buckets, so that their rows are not dealt out again
    with setting(load.spark, "spark.sql.shuffle.partitions", str(buckets)), \
            setting(load.spark, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(buckets)):
        df.repartition(buckets, BUCKET_KEY).write.mode("overwrite").bucketBy(buckets, BUCKET_KEY).sortBy(BUCKET_KEY) \
            .option("path", path).format("parquet").saveAsTable(temporary)
    load.spark.sql(f"DROP TABLE {temporary}")  # the definition goes, the files stay
    load.files.write(os.path.join(path, f"{_MARK}{buckets}"), "")
    load.intent["replace"].append(name)


def _buckets(files: Files, path: str) -> int | None:
    return next((int(n[len(_MARK):]) for n in files.names(path) if n.startswith(_MARK)), None)


def ensure_catalogue(spark: SparkSession, base: str, database: str, buckets: int = 64) -> dict[str, str]:
    """CREATE TABLE IF NOT EXISTS for the six warehouse tables over the folders under ``base``.

    Tables that are stored keep their rows and their number of buckets; the
    others are empty, the facts with ``buckets`` buckets.  Returns table name -> catalogue name.
    """
    recover(spark, base)
    files = Files(spark, base)
    _database(spark, base, database)
    out = {}
    for name, schema in WAREHOUSE_SCHEMAS.items():
        path = os.path.join(base, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        n = _buckets(files, path)
        if n is None and name in FACTS and not files.exists(path):
            n = buckets
            files.mkdirs(path)
            files.write(os.path.join(path, f"{_MARK}{n}"), "")
        clustered = f"CLUSTERED BY ({BUCKET_KEY}) SORTED BY ({BUCKET_KEY}) INTO {n} BUCKETS" if n else ""
        out[name] = f"`{database}`.`{name}`"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {out[name]} ({columns}) USING parquet {clustered} LOCATION '{path}'")
    return out


def save_catalogue(star: Star, base: str, database: str, buckets: int = 64) -> dict[str, str]:
    """Write all warehouse tables under ``base``, the facts bucketed, and define them in ``database``.

    ``buckets`` is chosen for the data's growth: a bucket should fit a task.
    A build with another number replaces both facts and their definitions together.
    """
    spark = star.d.spark
    load = Load(spark, base)
    _database(spark, base, database)
    for name, df in star.tables_by_order(buckets).items():
        if name not in WAREHOUSE_SCHEMAS:
            continue
        df = conform(df, WAREHOUSE_SCHEMAS[name])
        if name in FACTS:
            _stage_bucketed(load, name, df, buckets, database)
        else:
            load.stage_table(name, df)
    load.commit()
    for name in WAREHOUSE_SCHEMAS:  # definitions over files that are gone
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
    return ensure_catalogue(spark, base, database, buckets)


def order_margins(sales: DataFrame, orders: DataFrame) -> DataFrame:
    """Per order: lines, units, gross profit of the lines, and the margin left after the discount.

    Over bucketed tables neither the grouping of the lines nor the join shuffles.
    """
    lines = sales.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").cast("long").alias("units"),
                                          F.sum("gross_profit").cast(DEC_SUM).alias("gross_profit"))
    return orders.join(lines, "order_id").select(
        "order_id", "payment_gateway", "lines", "units", "gross_profit",
        (F.col("gross_profit") - F.col("discount_amount")).cast(DEC_SUM).alias("margin"))


def gateway_margins(sales: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, units, profit and margin by payment gateway."""
    return order_margins(sales, orders).groupBy("payment_gateway").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("lines").cast("long").alias("lines"), F.sum("units").cast("long").alias("units"),
        F.sum("gross_profit").cast(DEC_SUM).alias("gross_profit"), F.sum("margin").cast(DEC_SUM).alias("margin"))
