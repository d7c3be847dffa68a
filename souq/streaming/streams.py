"""Structured Streaming jobs (T1-T3) over file sources.

Sources are Parquet directories read with the batch schema (file streams
do not infer one); ``timestamp_ntz`` columns are cast to ``timestamp``
because watermarks need it.  Every job takes a checkpoint location, so a
restarted driver or a lost executor resumes from the last committed offset;
sinks are either the idempotent file sink or ``foreachBatch`` writes keyed
by epoch (a retried epoch overwrites its own output; a reader sees the last
epoch that is whole).
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import DEC_SUM, money
from ..operators.access_log import access_log_normalize
from ..operators.quality import CHECK_BOUNDARY, CHECK_RECONCILIATION
from ..sources.adapter import access_requests, order_money
from ..sources.driver import DRIVER_SCHEMAS
from ..sources.stored import Files


def file_stream(spark: SparkSession, source_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """Stream a table: the part files of the folder ``{table}.parquet``, or that one file.

    ``max_files`` bounds the files of a micro-batch; by default a trigger
    takes all that are new, so late rows are judged against the watermark of
    earlier triggers, not of neighbouring files.
    """
    path = os.path.join(source_dir, f"{table}.parquet")
    schema = DRIVER_SCHEMAS.get(table) or spark.read.parquet(path).schema
    stream = spark.readStream.format("parquet").schema(schema)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.load(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").load(source_dir)


def _run(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ---- results that a micro-batch rewrites ---------------------------------------------
def _epochs(spark: SparkSession, sink: str) -> list[int]:
    """Epochs whose folder is whole (its writer left the success mark), in order."""
    files = Files(spark, sink)
    found = [int(n.partition("=")[2]) for n in files.names(sink) if n.startswith("epoch=")]
    return sorted(e for e in found if files.exists(os.path.join(sink, f"epoch={e}", "_SUCCESS")))


def write_epoch(batch: DataFrame, sink: str, epoch: int, keep: int | None = None) -> None:
    """Write a micro-batch's result into a folder of its own; earlier ones stay readable meanwhile.

    A retried epoch replaces its own folder only.  With ``keep``, folders
    older than the last ``keep`` go once this one is whole.
    """
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch}"))
    if keep:
        files = Files(spark, sink)
        for old in [e for e in _epochs(spark, sink) if e <= epoch][:-keep]:
            files.delete(os.path.join(sink, f"epoch={old}"))


def read_last_epoch(spark: SparkSession, sink: str) -> DataFrame:
    """The result of the last epoch that was written wholly."""
    done = _epochs(spark, sink)
    if not done:
        raise FileNotFoundError(f"no finished epoch under {sink}")
    return spark.read.parquet(os.path.join(sink, f"epoch={done[-1]}"))


# ---- T1 -------------------------------------------------------------------------
def order_window_counts(orders_stream: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    o = orders_stream.select(F.col("o_orderdate").cast("timestamp").alias("order_ts"),
                             money(F.col("o_totalprice")).alias("gross_amount"))
    return (o.withWatermark("order_ts", watermark)
            .groupBy(F.window("order_ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("gross_amount").cast(DEC_SUM).alias("gross_amount")))


def stream_order_counts(spark: SparkSession, source_dir: str, sink: str, checkpoint: str,
                        mode: str = "complete", window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Tumbling-window order count and amount.

    ``append`` writes each window once, after the watermark passes its end
    (late rows inside the watermark still count; windows still open at the
    end of the input are held back).  ``complete`` writes the whole
    (window-sized) result of every micro-batch into a folder of its epoch and
    so equals the batch aggregate when the input is drained; the last two
    epochs are kept, and a reader gets the last whole one.
    """
    agg = order_window_counts(file_stream(spark, source_dir, "orders"), window, watermark)
    flat = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "orders", "gross_amount")
    if mode == "append":
        _run(flat.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)
    else:
        _run(flat.writeStream.outputMode("complete").foreachBatch(lambda b, e: write_epoch(b, sink, e, keep=2)), checkpoint)
        return read_last_epoch(spark, sink)
    return spark.read.parquet(sink)


def stream_purchase_counts(spark: SparkSession, source_dir: str, sink: str, checkpoint: str,
                           mode: str = "complete", window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """T1 over the event stream: purchases per tumbling window with their value."""
    ev = file_stream(spark, source_dir, "events").where(F.col("event_type") == "purchase")
    agg = (ev.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(12,2)").alias("v"))
           .withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("purchases"), F.sum("v").cast(DEC_SUM).alias("purchase_value")))
    flat = agg.select(F.col("w.start").alias("window_start"), "purchases", "purchase_value")
    if mode == "append":
        _run(flat.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)
    else:
        _run(flat.writeStream.outputMode("complete").foreachBatch(lambda b, e: write_epoch(b, sink, e, keep=2)), checkpoint)
        return read_last_epoch(spark, sink)
    return spark.read.parquet(sink)


# ---- T2 --------------------------------------------------------------------------
def flag_orders(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """G1 and G3 as per-row flags on priced orders."""
    parts = F.col("gross_amount") - F.col("discount_amount") + F.col("vat_amount") + F.col("shipping_fee")
    recon = F.coalesce(F.abs(F.col("net_amount") - parts) > 0.01, F.lit(False))
    bound = F.coalesce((F.col("net_amount") < 0) | (F.col("gross_amount") < 0)
                       | (F.col("order_date") > F.lit(as_of).cast("timestamp")), F.lit(False))
    return orders.withColumns({"reconciliation_fail": recon, "boundary_fail": bound})


def stream_dq_checks(spark: SparkSession, source_dir: str, sink: str, checkpoint: str,
                     as_of: dt.date) -> DataFrame:
    """The per-order audits on every micro-batch; failing orders are
    written under ``epoch=<id>`` with overwrite, so a replayed epoch
    replaces its own output (exactly-once at the sink)."""
    o = order_money(file_stream(spark, source_dir, "orders")).select(
        F.col("o_orderkey").alias("order_id"), "gross_amount", "discount_amount", "vat_amount",
        "shipping_fee", "net_amount", F.col("o_orderdate").cast("timestamp").alias("order_date"))

    def write(batch: DataFrame, epoch: int) -> None:
        bad = flag_orders(batch, as_of).where("reconciliation_fail OR boundary_fail")
        bad.select("order_id", "reconciliation_fail", "boundary_fail") \
            .write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch}"))

    _run(o.writeStream.foreachBatch(write), checkpoint)
    return spark.read.parquet(sink).select("order_id", "reconciliation_fail", "boundary_fail")


def audit_rows(orders: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per order and row-level audit (G1, G3): check_name, failed, order_id, order_date."""
    checks = F.array(F.struct(F.lit(CHECK_RECONCILIATION).alias("check_name"), F.col("reconciliation_fail").alias("failed")),
                     F.struct(F.lit(CHECK_BOUNDARY).alias("check_name"), F.col("boundary_fail").alias("failed")))
    return flag_orders(orders, as_of).select(F.explode(checks).alias("c"), "order_id", "order_date") \
        .select("c.*", "order_id", "order_date")


def audit_state(rows: DataFrame) -> DataFrame:
    """Running counters of each audit: rows checked, records failed, status, first failing order, latest order date.

    On a stream this is the keyed state: one row per audit in the state
    store.  Rows are counted inside their partition first, so what a
    micro-batch sends to an audit's state is one partial row per task,
    however many orders it brings.
    """
    failed = F.count_if("failed")
    return rows.groupBy("check_name").agg(
        F.count(F.lit(1)).alias("checked_records"), failed.alias("failed_records"),
        F.min(F.when(F.col("failed"), F.col("order_id"))).alias("first_failed_order"),
        F.max("order_date").alias("latest_order")) \
        .withColumn("passed", F.col("failed_records") == 0) \
        .withColumn("status", F.when(F.col("passed"), "PASS").otherwise("FAIL"))


def stream_audit_state(spark: SparkSession, source_dir: str, sink: str, checkpoint: str, as_of: dt.date,
                       max_files: int | None = None) -> DataFrame:
    """Running totals of the row-level audits over all micro-batches so far.

    Every epoch writes the state after it (one row per audit); the result is
    the last whole one and equals the batch audits G1 and G3 over everything
    read.  A restart goes on from the stored state: nothing is counted twice.
    """
    o = order_money(file_stream(spark, source_dir, "orders", max_files)).select(
        F.col("o_orderkey").alias("order_id"), "gross_amount", "discount_amount", "vat_amount",
        "shipping_fee", "net_amount", F.col("o_orderdate").cast("timestamp").alias("order_date"))
    state = audit_state(audit_rows(o, as_of))
    _run(state.writeStream.outputMode("complete").foreachBatch(lambda b, e: write_epoch(b, sink, e)), checkpoint)
    return read_last_epoch(spark, sink)


def audit_trail(spark: SparkSession, sink: str) -> DataFrame:
    """What each epoch added to each audit, and whether its status changed with it (the alerts).

    One row per audit and epoch, so the window over an audit's epochs is small.
    """
    done = _epochs(spark, sink)
    if not done:
        raise FileNotFoundError(f"no finished epoch under {sink}")
    states = spark.read.option("basePath", sink).parquet(*[os.path.join(sink, f"epoch={e}") for e in done])
    w = Window.partitionBy("check_name").orderBy("epoch")
    return states.select(
        "check_name", F.col("epoch").cast("long").alias("epoch"),
        (F.col("checked_records") - F.coalesce(F.lag("checked_records").over(w), F.lit(0))).alias("new_records"),
        (F.col("failed_records") - F.coalesce(F.lag("failed_records").over(w), F.lit(0))).alias("new_failures"), "status",
        (F.col("status") != F.coalesce(F.lag("status").over(w), F.lit("PASS"))).alias("changed"))


# ---- T3 ----------------------------------------------------------------------------
def stream_access_log(spark: SparkSession, source_dir: str, sink: str, checkpoint: str,
                      watermark: str = "1 hour") -> DataFrame:
    """Normalise consent requests and append them to the audit log,
    dropping repeats of (user, status, minute) that arrive within the
    watermark; state older than the watermark is evicted."""
    rows = access_log_normalize(access_requests(file_stream(spark, source_dir, "events")))
    rows = rows.withColumn("login_minute", F.date_trunc("minute", "login_time"))
    dedup = rows.withWatermark("login_time", watermark) \
        .dropDuplicatesWithinWatermark(["user_id", "consent_status", "login_minute"])
    _run(dedup.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)
    return spark.read.parquet(sink)
