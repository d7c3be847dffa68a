"""Marts kept up with the load (W9-W11 over stored partials).

A mart is a sum over orders, so it splits into partials per order month that
merge by adding.  The partials are stored beside the facts, partitioned by
month.  A load notes the months it changed (in the same commit as the facts);
``refresh`` recomputes the partials of those months only, and a mart merges
the stored partials: one row per store and day, product and month, or
customer and month, instead of one per order.

Distinct orders merge by adding because an order is in one month only: the
load keeps one row for each order_id (its key), wherever its date moves.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_from_key
from ..functions.money import DEC_SUM, safe_ratio
from ..sources.stored import Files, Load, recover, stale_partitions
from . import marts as M
from .build import ALL_MONTHS, MONTH_COL, WrittenStar, _months

PARTIALS = ("mart_part_daily", "mart_part_product", "mart_part_customer", "mart_part_distinct")

#: log2 of a sketch's registers: a standard error of 1.04 / sqrt(2^14), below one percent
SKETCH_K = 14


#: rows of a fact that one task aggregates to a part of a month's partial
ROWS_PER_PART = 500_000


def _dealt(fact: DataFrame, key: str, columns: list[str], parts: int) -> DataFrame:
    """Rows dealt out once, by month and ``parts`` parts of ``key``.

    Groups that hold month, ``_part`` and the key are whole in a task then, and
    a partition of the result is ``parts`` files: neither the groups nor the
    write deals the rows out again.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_part")
    return fact.select(MONTH_COL, part, *columns).repartition(MONTH_COL, "_part")


def partials(fact_orders: DataFrame, fact_sales: DataFrame, parts: tuple[int, int] = (1, 1)) -> dict[str, DataFrame]:
    """The mergeable partials of facts with their month column.

    ``parts``: in how many parts a month's orders and sales are aggregated.
    """
    money = {"gross_amount": "gross", "discount_amount": "discounts", "vat_amount": "vat", "net_amount": "net"}
    sums = ["gross_sales", "item_cost", "gross_profit"]

    def by_store(columns: list[str]) -> DataFrame:
        return _dealt(fact_orders, "store_id", ["store_id", "date_id", *columns], parts[0])

    by_customer = _dealt(fact_orders, "customer_id", ["customer_id", "date_id", "order_id", "net_amount"], parts[0])
    by_product = _dealt(fact_sales, "product_id", ["product_id", "quantity", *sums], parts[1])
    return {
        "mart_part_daily": by_store(["order_id", *money]).groupBy(MONTH_COL, "_part", "store_id", "date_id").agg(
            F.countDistinct("order_id").alias("orders"), F.count("net_amount").alias("net_rows"),
            *[F.sum(c).cast(DEC_SUM).alias(n) for c, n in money.items()]).drop("_part"),
        "mart_part_product": by_product.groupBy(MONTH_COL, "_part", "product_id").agg(
            F.sum("quantity").cast("long").alias("units"),
            *[F.sum(c).cast(DEC_SUM).alias(c) for c in sums]).drop("_part"),
        "mart_part_customer": by_customer.groupBy(MONTH_COL, "_part", "customer_id").agg(
            F.max("date_id").alias("last_date_id"), F.countDistinct("order_id").alias("orders"),
            F.sum("net_amount").cast(DEC_SUM).alias("net")).drop("_part"),
        # distinct counts do not add up; sketches of them merge (L5, opt-in)
        "mart_part_distinct": by_store(["order_id", "customer_id"]).groupBy(MONTH_COL, "_part", "store_id", "date_id").agg(
            F.hll_sketch_agg("order_id", SKETCH_K).alias("order_sketch"),
            F.hll_sketch_agg("customer_id", SKETCH_K).alias("customer_sketch")).drop("_part"),
    }


def refresh(spark: SparkSession, base: str) -> list[int]:
    """Bring the stored partials up to the facts; returns the months that were recomputed.

    The months are those that loads have noted since the last refresh, or all
    when a partial is missing or the facts were rebuilt.  Only their fact
    partitions are read and only their partial partitions replaced; the notes
    go with the same commit, so an interrupted refresh is done again.
    """
    recover(spark, base)
    star = WrittenStar(spark, base, None)
    orders, sales = (star._read(n, keep_month=True) for n in ("dw_fact_orders", "dw_fact_sales"))
    noted = stale_partitions(spark, base)
    files = Files(spark, base)
    load = Load(spark, base, files)
    whole = ALL_MONTHS in noted or not all(files.exists(os.path.join(base, n)) for n in PARTIALS)
    months = sorted(_months(orders) | _months(sales)) if whole else sorted(map(int, noted))
    if not whole:
        orders, sales = (f.where(F.col(MONTH_COL).isin(months)) for f in (orders, sales))
    # counts come from the files' footers
    parts = tuple(-(-f.count() // (ROWS_PER_PART * max(1, len(months)))) or 1 for f in (orders, sales))
    for name, df in partials(orders, sales, parts).items():
        if whole:
            load.stage_table(name, df, MONTH_COL, placed=True)
        else:
            load.stage_partitions(name, df, MONTH_COL, months, placed=True)
    load.mark(fresh=sorted(noted))
    load.commit()
    return months


class StoredMarts:
    """W9-W11 merged from the stored partials under ``base``.

    ``refresh`` them first: a mart of stale partials would be wrong, so that is an error here.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.star = WrittenStar(spark, base, None)
        self.spark, self.base = spark, base

    def _part(self, name: str) -> DataFrame:
        recover(self.spark, self.base)
        stale = stale_partitions(self.spark, self.base)
        if stale:
            raise RuntimeError(f"partials are older than the facts in {sorted(stale)}: refresh them first")
        return self.spark.read.parquet(os.path.join(self.base, name))

    def merchant_daily(self) -> DataFrame:
        """A store's day lies in one month, so its partial is its row."""
        agg = self._part("mart_part_daily").select(
            "store_id", "date_id", F.col("orders").alias("total_orders"), F.col("gross").alias("gross_merchandise_value"),
            F.col("discounts").alias("total_discounts"), F.col("vat").alias("total_vat_collected"),
            F.col("net").alias("net_revenue"), safe_ratio(F.col("net"), F.col("net_rows")).alias("average_order_value"))
        return M.name_daily(agg, self.star.dim_store, self.star.dim_merchant)

    def product_performance(self) -> DataFrame:
        """W10 from the sums of each product's months."""
        agg = self._part("mart_part_product").groupBy("product_id").agg(
            F.sum("units").cast("long").alias("total_units_sold"),
            F.sum("gross_sales").cast(DEC_SUM).alias("total_gross_revenue"),
            F.sum("item_cost").cast(DEC_SUM).alias("total_cogs"),
            F.sum("gross_profit").cast(DEC_SUM).alias("total_gross_profit"))
        return M.name_products(agg, self.star.dim_product)

    def approx_distinct(self, *grain: str) -> DataFrame:
        """L5, opt-in: distinct orders and customers at any grain, merged from the sketches of each
        store and day.

        ``grain`` names columns of store_id, merchant_id, industry_category,
        date_id, order_month; none gives one row for all.  Estimates have a standard
        error below one percent; exact counts stay the default everywhere else.
        """
        part = self._part("mart_part_distinct")
        if {"merchant_id", "industry_category"} & set(grain):
            part = part.join(self.star.dim_store.select("store_id", "merchant_id", "industry_category"), "store_id")
        return part.groupBy(*grain).agg(
            F.hll_sketch_estimate(F.hll_union_agg("order_sketch")).alias("approx_orders"),
            F.hll_sketch_estimate(F.hll_union_agg("customer_sketch")).alias("approx_customers"))

    def customer_rfm(self, as_of: dt.date) -> DataFrame:
        """W11 from the latest date and the sums of each customer's months."""
        agg = self._part("mart_part_customer").groupBy("customer_id").agg(
            F.max(date_from_key("last_date_id")).alias("last_order_date"),
            F.sum("orders").cast("long").alias("frequency_orders"),
            F.sum("net").cast(DEC_SUM).alias("monetary_value"))
        return M.name_customers(agg, self.star.dim_customer, as_of)
