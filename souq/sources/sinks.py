"""Scans, sinks and table management.

Writers are distributed (one file per task); nothing is buffered on the
driver.  Paths default to the shared checkpoint folder the cluster names in
``spark.checkpoint.dir`` (see :func:`souq.session.checkpoint_dir`).
"""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, remove_at_exit, shuffles_end_with_actions
from .stored import CODEC, Files, recover, restore, swap


def work_path(spark: SparkSession, *parts: str) -> str:
    """A fresh location under the shared checkpoint folder; it goes when the driver ends."""
    path = os.path.join(checkpoint_dir(spark), "souq-work", *parts, uuid.uuid4().hex)
    remove_at_exit(spark, path)
    return path


def written_once(df: DataFrame) -> DataFrame:
    """The same rows, computed here, once, and read back from files by whatever uses them.

    For frames that several steps read: an exact copy costs one write, a plan that
    is run again costs its shuffles again.
    """
    path = work_path(df.sparkSession, "once")
    with shuffles_end_with_actions(df.sparkSession):
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def written_while(df: DataFrame):
    """The rows of :func:`written_once` for the steps inside; their files go when those are done."""
    path = work_path(df.sparkSession, "once")
    try:
        with shuffles_end_with_actions(df.sparkSession):
            df.write.option("compression", CODEC).parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        Files(df.sparkSession, path).delete(path)


# ---- S1-S3: scans -------------------------------------------------------------
def scan_table(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None,
               where: str | None = None) -> DataFrame:
    """Read with an explicit schema; projection and filter reach the scan."""
    df = spark.read.schema(schema).parquet(path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def scan_whole_table(spark: SparkSession, name: str) -> DataFrame:
    """Every column of a registered table."""
    return spark.table(name)


def param_scan(spark: SparkSession, sql: str, **params) -> DataFrame:
    """S3: bound parameters (``:name``) instead of string interpolation."""
    return spark.sql(sql, args=params)


# ---- S4, S5: append and full reload ------------------------------------------------
def append_sink(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a frame to a table directory."""
    df.write.mode("append").format(fmt).save(path)


def truncate_reload(spark: SparkSession, tables: dict[str, DataFrame], base: str,
                    order: list[str] | None = None) -> dict[str, str]:
    """Full reload, child tables first.

    Each table is written completely to a staging directory and only then
    swapped into place, so a failed write never leaves a half-written table.
    """
    out = {}
    recover(spark, base)
    for name in (order or list(tables)):
        final, staging = os.path.join(base, name), os.path.join(base, f"_{name}__staging")
        tables[name].write.mode("overwrite").option("compression", CODEC).parquet(staging)
        swap(spark, staging, final)
        out[name] = final
    return out


# ---- S7, S8: lake exports ---------------------------------------------------------------
def csv_lake_export(tables: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Each table to ``{base}/raw_data/{name}`` as CSV with a header
    (a directory of part files written by the executors)."""
    out = {}
    for name, df in tables.items():
        path = os.path.join(base, "raw_data", name)
        df.write.mode("overwrite").option("header", True).csv(path)
        out[name] = path
    return out


def parquet_lake_export(df: DataFrame, path: str, partition_cols: list[str]) -> str:
    """Partitioned Parquet; readers prune partitions from filters.

    Rows are first brought together by the partition columns (large ones are
    split), so a partition is few files instead of one per task.
    """
    df.hint("rebalance", *partition_cols).write.mode("overwrite").partitionBy(*partition_cols).parquet(path)
    return path


# ---- S9, S10: table definitions and views -------------------------------------------------
# The warehouse tables and the audit log's columns.
DEC = T.DecimalType(10, 2)
WAREHOUSE_SCHEMAS = {
    "dw_dim_merchant": T.StructType([
        T.StructField("merchant_id", T.LongType(), False), T.StructField("merchant_name", T.StringType()),
        T.StructField("subscription_plan", T.StringType()), T.StructField("commercial_register_no", T.StringType()),
        T.StructField("vat_number", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("region_name_en", T.StringType()), T.StructField("joined_date", T.DateType())]),
    "dw_dim_store": T.StructType([
        T.StructField("store_id", T.LongType(), False), T.StructField("merchant_id", T.LongType(), False),
        T.StructField("store_name_en", T.StringType()), T.StructField("domain_url", T.StringType()),
        T.StructField("industry_category", T.StringType()), T.StructField("store_status", T.StringType())]),
    "dw_dim_customer": T.StructType([
        T.StructField("customer_id", T.LongType(), False), T.StructField("store_id", T.LongType(), False),
        T.StructField("full_name", T.StringType()), T.StructField("phone_number", T.StringType()),
        T.StructField("gender", T.StringType()), T.StructField("region_name_en", T.StringType())]),
    "dw_dim_product": T.StructType([
        T.StructField("product_id", T.LongType(), False), T.StructField("store_id", T.LongType(), False),
        T.StructField("product_name_en", T.StringType()), T.StructField("category_name_en", T.StringType()),
        T.StructField("sku", T.StringType()), T.StructField("base_price", DEC), T.StructField("cost_price", DEC),
        T.StructField("current_stock", T.IntegerType())]),
    "dw_fact_sales": T.StructType([
        T.StructField("order_id", T.LongType(), False), T.StructField("order_item_id", T.LongType(), False),
        T.StructField("date_id", T.IntegerType(), False), T.StructField("store_id", T.LongType(), False),
        T.StructField("customer_id", T.LongType(), False), T.StructField("product_id", T.LongType(), False),
        T.StructField("quantity", T.IntegerType(), False), T.StructField("unit_price", DEC, False),
        T.StructField("gross_sales", DEC, False), T.StructField("item_cost", DEC, False),
        T.StructField("gross_profit", DEC, False)]),
    "dw_fact_orders": T.StructType([
        T.StructField("order_id", T.LongType(), False), T.StructField("date_id", T.IntegerType(), False),
        T.StructField("store_id", T.LongType(), False), T.StructField("customer_id", T.LongType(), False),
        T.StructField("order_status", T.StringType()), T.StructField("payment_gateway", T.StringType()),
        T.StructField("courier_partner", T.StringType()), T.StructField("gross_amount", DEC),
        T.StructField("discount_amount", DEC), T.StructField("vat_amount", DEC),
        T.StructField("shipping_fee", DEC), T.StructField("net_amount", DEC)]),
}


def ensure_tables(spark: SparkSession, base: str, schemas: dict[str, T.StructType] | None = None) -> dict[str, str]:
    """Create each warehouse table as an empty Parquet dataset with its
    declared schema when it does not exist yet (CREATE TABLE IF NOT EXISTS).

    A table that an interrupted write set aside exists: it gets its name back.
    """
    out = {}
    recover(spark, base)
    for name, schema in (schemas or WAREHOUSE_SCHEMAS).items():
        path = os.path.join(base, name)
        restore(spark, path)
        if not Files(spark, path).exists(path):
            spark.createDataFrame([], schema).write.parquet(path)
        out[name] = path
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast a frame to a declared table schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def register_views(views: dict[str, DataFrame]) -> list[str]:
    """CREATE OR REPLACE (temporary) VIEW for each frame."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


# ---- S11: audit log ----------------------------------------------------------------------------
# Columns of the audit log.
AUDIT_BASE_COLUMNS = ["log_id", "user_id", "consent_status", "device_info", "ip_address", "login_time"]
AUDIT_OPTIONAL_COLUMNS = ["full_name", "email", "country", "city", "region", "timezone",
                          "preferred_language", "consent_notes"]


def audit_log_append(new_rows: DataFrame, path: str) -> None:
    """Append normalised rows; files with and without the optional
    columns coexist and are reconciled on read (``mergeSchema``)."""
    new_rows.write.mode("append").parquet(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("mergeSchema", True).parquet(path)
    for c in AUDIT_OPTIONAL_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.select(*AUDIT_BASE_COLUMNS, *AUDIT_OPTIONAL_COLUMNS)


# ---- S12: JSON records ------------------------------------------------------------------------------
def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row (column ``json``)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
