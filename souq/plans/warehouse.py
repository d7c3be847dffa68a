"""Warehouse build: star-schema dimensions and facts (W1-W8), keyed upsert.

Scale notes
-----------
* Dimension joins to ``regions`` are broadcast: five rows by definition.
  Every other join is left to AQE, which broadcasts from *measured* sizes
  and otherwise plans a sort-merge join; nothing here forces a broadcast of
  a table that grows with the data.
* ``fact_orders`` reduces payments and shipments to one row per order with
  ``max_by`` *before* joining.  ``max_by`` is a partial (map-side) aggregate,
  so an order with a third of all payments is combined inside each task and
  never lands whole in one task, and the joins cannot fan out (Q8).
* Keep-last upsert uses the same ``max_by`` over a struct of the row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_from_key, date_key
from ..functions.money import DEC


def dim_merchant(merchants: DataFrame, regions: DataFrame) -> DataFrame:
    """Merchants LEFT JOIN regions -> 8 columns."""
    r = F.broadcast(regions.select("region_id", "region_name_en"))
    return merchants.join(r, "region_id", "left").select(
        "merchant_id", "merchant_name", "subscription_plan", "commercial_register_no",
        "vat_number", "status", "region_name_en", "joined_date",
    )


def dim_store(stores: DataFrame) -> DataFrame:
    """Store projection."""
    return stores.select("store_id", "merchant_id", "store_name_en", "domain_url",
                         "industry_category", "store_status")


def dim_customer(customers: DataFrame, regions: DataFrame) -> DataFrame:
    """Customers LEFT JOIN regions."""
    r = F.broadcast(regions.select("region_id", "region_name_en"))
    return customers.join(r, "region_id", "left").select(
        "customer_id", "store_id", "full_name", "phone_number", "gender", "region_name_en")


def dim_product(products: DataFrame, categories: DataFrame, inventory: DataFrame) -> DataFrame:
    """Products LEFT JOIN categories LEFT JOIN inventory.

    Missing category -> 'General', missing stock -> 0.  Inventory is reduced to
    its last row per product first (UNIQUE(product_id) is not enforced here).
    """
    cat = categories.select("category_id", "category_name_en")
    inv = inventory.groupBy("product_id").agg(
        F.max_by("stock_quantity", "inventory_id").alias("stock_quantity"))
    return (
        products.join(cat, "category_id", "left")
        .join(inv, "product_id", "left")
        .select(
            "product_id", "store_id", "product_name_en",
            F.coalesce(F.col("category_name_en"), F.lit("General")).alias("category_name_en"),
            "sku", "base_price", "cost_price",
            F.coalesce(F.col("stock_quantity"), F.lit(0)).alias("current_stock"),
        )
    )


def dim_date(spark: SparkSession, start: dt.date | Column, end: dt.date | Column) -> DataFrame:
    """One row per day in [start, end].

    Weekend = Friday/Saturday (weekday 4, 5); Ramadan season = months 3-4
    (Q19, reproduced); national-day season = 15-25 September.
    """
    s = F.lit(start) if isinstance(start, dt.date) else start
    e = F.lit(end) if isinstance(end, dt.date) else end
    days = spark.range(1).select(F.explode(F.sequence(s, e)).alias("full_date"))
    d = F.col("full_date")
    return days.select(
        date_key(d).alias("date_id"),
        d.alias("full_date"),
        F.date_format(d, "EEEE").alias("day_of_week"),
        F.dayofmonth(d).alias("day_number"),
        F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        F.year(d).alias("year"),
        *[c.alias(n) for n, c in season_flags(d).items()],
    )


def season_flags(d: Column) -> dict[str, Column]:
    """Calendar flags of a date."""
    return {"is_weekend": F.weekday(d).isin(4, 5), "is_ramadan_season": F.month(d).isin(3, 4),
            "is_national_day_season": (F.month(d) == 9) & F.dayofmonth(d).between(15, 25)}


def dim_date_for(orders: DataFrame, day: Column | None = None) -> DataFrame:
    """Calendar covering whole years from the first to the last order (Q10).

    The horizon comes from the data through scalar subqueries, so the
    calendar never silently drops an order date.  ``day`` is the rows' date,
    by default that of ``order_date``.
    """
    day = F.to_date("order_date") if day is None else day
    bounds = orders.select(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()
    lo = F.trunc(bounds["lo"], "year")
    hi = F.date_sub(F.add_months(F.trunc(bounds["hi"], "year"), 12), 1)
    return dim_date(orders.sparkSession, lo, hi)


def fact_sales(order_items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order item; item_cost uses the current product cost."""
    o = orders.select("order_id", date_key("order_date").alias("date_id"), "store_id", "customer_id")
    p = products.select("product_id", "cost_price")
    it = order_items.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "total_price")
    j = it.join(o, "order_id").join(p, "product_id")
    item_cost = (F.col("cost_price") * F.col("quantity")).cast(DEC)
    return j.select(
        "order_id", "order_item_id", "date_id", "store_id", "customer_id", "product_id",
        "quantity", "unit_price",
        F.col("total_price").alias("gross_sales"),
        item_cost.alias("item_cost"),
        (F.col("total_price") - item_cost).cast(DEC).alias("gross_profit"),
    )


def last_per_key(df: DataFrame, key: str, order_col: str, cols: list[str]) -> DataFrame:
    """One row per key: the row with the highest ``order_col`` (map-side combined)."""
    return df.groupBy(key).agg(*[F.max_by(c, order_col).alias(c) for c in cols])


def fact_orders(orders: DataFrame, payments: DataFrame, shipments: DataFrame) -> DataFrame:
    """One row per order; last payment and last shipment; 'Unpaid'/'Unshipped'."""
    pay = last_per_key(payments, "order_id", "payment_id", ["payment_gateway"])
    ship = last_per_key(shipments, "order_id", "shipment_id", ["courier_partner"])
    return (
        orders.join(pay, "order_id", "left").join(ship, "order_id", "left")
        .select(
            "order_id",
            date_key("order_date").alias("date_id"),
            "store_id", "customer_id", "order_status",
            F.coalesce(F.col("payment_gateway"), F.lit("Unpaid")).alias("payment_gateway"),
            F.coalesce(F.col("courier_partner"), F.lit("Unshipped")).alias("courier_partner"),
            "gross_amount", "discount_amount", "vat_amount", "shipping_fee", "net_amount",
        )
    )


def order_wide(fact: DataFrame, d_store: DataFrame, d_merchant: DataFrame) -> DataFrame:
    """The dashboard's wide order view, built on the real schema (Q1).

    order_amount_sar = gross - discount (Q2).  The order date comes from the
    date key, so no calendar join is needed.
    """
    st = d_store.select("store_id", "merchant_id", F.col("industry_category").alias("store_category"))
    m = d_merchant.select(
        "merchant_id", "merchant_name",
        F.col("region_name_en").alias("merchant_region"),
        F.col("subscription_plan").alias("subscription_tier"),
    )
    return (
        fact.join(st, "store_id").join(m, "merchant_id")
        .select(
            "order_id",
            date_from_key("date_id").alias("order_date"),
            (F.col("gross_amount") - F.col("discount_amount")).cast(DEC).alias("order_amount_sar"),
            F.col("vat_amount").alias("vat_amount_sar"),
            F.col("payment_gateway").alias("payment_method"),
            "merchant_name", "merchant_region", "subscription_tier", "store_category",
        )
    )


def upsert_by_key(target: DataFrame, source: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """REPLACE INTO semantics.

    The source is first reduced to its last row per key (highest
    ``order_col``; if None the greatest row wins, a repeatable tie-break),
    then target rows with those keys are replaced.  Applying the same batch
    twice gives the same table (idempotent).
    """
    cols = source.columns
    if order_col is None:
        src = source.groupBy(*keys).agg(F.max(F.struct(*[c for c in cols if c not in keys])).alias("_r"))
    else:
        rest = [c for c in cols if c not in keys]
        src = source.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_col).alias("_r"))
    src = src.select(*keys, "_r.*").select(*cols)
    kept = target.join(src.select(*keys), keys, "left_anti")
    return kept.unionByName(src.select(*target.columns))
