"""Rolling and preference features.

Orders are reduced to one row per merchant and day before the range
window, so each window partition holds at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_from_key
from ..functions.money import DEC_SUM, safe_ratio


def _merchant_daily(fact_orders: DataFrame, d_store: DataFrame) -> DataFrame:
    per_store = fact_orders.groupBy("store_id", "date_id").agg(
        F.sum("net_amount").alias("net"), F.count(F.lit(1)).alias("orders"))
    return (per_store.join(d_store.select("store_id", "merchant_id"), "store_id")
            .groupBy("merchant_id", "date_id").agg(F.sum("net").alias("net"), F.sum("orders").alias("orders"))
            .withColumn("day", date_from_key("date_id"))
            .withColumn("day_no", F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))))


def feature_avg_aov_30d(fact_orders: DataFrame, d_store: DataFrame, days: int = 30) -> DataFrame:
    """Per merchant and order day, net revenue / orders over the trailing ``days`` days."""
    d = _merchant_daily(fact_orders, d_store)
    w = Window.partitionBy("merchant_id").orderBy("day_no").rangeBetween(-(days - 1), 0)
    return d.select("merchant_id", "day",
                    F.sum("net").over(w).cast(DEC_SUM).alias(f"net_{days}d"),
                    F.sum("orders").over(w).cast("long").alias(f"orders_{days}d")) \
        .withColumn(f"avg_aov_{days}d", safe_ratio(F.col(f"net_{days}d"), F.col(f"orders_{days}d")))


def feature_orders_7d(fact_orders: DataFrame, d_store: DataFrame, days: int = 7) -> DataFrame:
    """X11: per merchant and order day, orders over the trailing ``days`` days."""
    d = _merchant_daily(fact_orders, d_store)
    w = Window.partitionBy("merchant_id").orderBy("day_no").rangeBetween(-(days - 1), 0)
    return d.select("merchant_id", "day", F.sum("orders").over(w).cast("long").alias(f"orders_last_{days}d"))


def customer_preferred_gateway(fact_orders: DataFrame, gateway: str = "Mada") -> DataFrame:
    """X11: each customer's most used payment gateway (ties: alphabetical) and
    the flag "prefers ``gateway``".  The window sees one row per gateway."""
    c = fact_orders.groupBy("customer_id", "payment_gateway").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("n"), "payment_gateway")
    top = c.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return top.select("customer_id", F.col("payment_gateway").alias("preferred_gateway"),
                      F.col("n").alias("orders_with_gateway"),
                      (F.col("payment_gateway") == gateway).cast("int").alias(f"{gateway.lower()}_preferred_flag"))
