"""Analytical marts (W9-W14) and order pricing.

Each mart aggregates the fact at its own grain *first* and joins the
dimensions afterwards.  The extra group columns of the reference views are
functionally dependent on the grain key (merchant attributes on store_id,
full_date on date_id), so this gives the same rows while the joins see one
row per group instead of one per order.  COUNT(DISTINCT) is always computed
at the final grain, never rolled up (Q6).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_from_key
from ..functions.money import DEC, DEC_SUM, safe_ratio


def mart_merchant_daily(fact_orders: DataFrame, d_store: DataFrame, d_merchant: DataFrame,
                        d_date: DataFrame | None = None) -> DataFrame:
    """Per store and day: orders, gross, discounts, VAT, net, mean net.

    Orders are counted distinct, as declared, whatever the fact holds.  The
    date comes from the key, so no order is lost; with ``d_date`` given, only
    days of that calendar are kept.
    """
    if d_date is not None:
        # bounded by the calendar's days
        fact_orders = fact_orders.join(F.broadcast(d_date.select("date_id")), "date_id", "left_semi")
    agg = fact_orders.groupBy("store_id", "date_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("gross_amount").cast(DEC_SUM).alias("gross_merchandise_value"),
        F.sum("discount_amount").cast(DEC_SUM).alias("total_discounts"),
        F.sum("vat_amount").cast(DEC_SUM).alias("total_vat_collected"),
        F.sum("net_amount").cast(DEC_SUM).alias("net_revenue"),
        safe_ratio(F.sum("net_amount"), F.count("net_amount")).alias("average_order_value"),
    )
    return name_daily(agg, d_store, d_merchant)


def name_daily(agg: DataFrame, d_store: DataFrame, d_merchant: DataFrame) -> DataFrame:
    """Store, merchant and date columns of the daily mart's aggregate."""
    st = d_store.select("store_id", "merchant_id", "industry_category")
    m = d_merchant.select("merchant_id", "merchant_name", "subscription_plan")
    return (
        agg.join(st, "store_id").join(m, "merchant_id").withColumn("full_date", date_from_key("date_id"))
        .select("store_id", "merchant_id", "merchant_name", "subscription_plan", "industry_category",
                "date_id", "full_date", "total_orders", "gross_merchandise_value", "total_discounts",
                "total_vat_collected", "net_revenue", "average_order_value")
    )


def mart_product_performance(fact_sales: DataFrame, d_product: DataFrame) -> DataFrame:
    """Per product: units, revenue, COGS, profit, margin %.

    margin = profit / NULLIF(revenue, 0) * 100 as an unrounded double (the
    reference rounds to 2 places for display).
    """
    agg = fact_sales.groupBy("product_id").agg(
        F.sum("quantity").cast("long").alias("total_units_sold"),
        F.sum("gross_sales").cast(DEC_SUM).alias("total_gross_revenue"),
        F.sum("item_cost").cast(DEC_SUM).alias("total_cogs"),
        F.sum("gross_profit").cast(DEC_SUM).alias("total_gross_profit"),
    )
    return name_products(agg, d_product)


def name_products(agg: DataFrame, d_product: DataFrame) -> DataFrame:
    """Product columns and margin of the product mart's aggregate."""
    p = d_product.select("product_id", "product_name_en", "category_name_en", "store_id")
    return agg.join(p, "product_id").select(
        "product_id", "product_name_en", "category_name_en", "store_id",
        "total_units_sold", "total_gross_revenue", "total_cogs", "total_gross_profit",
        (safe_ratio(F.col("total_gross_profit"), F.col("total_gross_revenue")) * 100).alias("profit_margin_pct"),
    )


def mart_customer_rfm(d_customer: DataFrame, fact_orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Recency (days from the last order to ``as_of``), frequency, monetary."""
    agg = fact_orders.groupBy("customer_id").agg(
        F.max(date_from_key("date_id")).alias("last_order_date"),
        F.countDistinct("order_id").alias("frequency_orders"),
        F.sum("net_amount").cast(DEC_SUM).alias("monetary_value"),
    )
    return name_customers(agg, d_customer, as_of)


def name_customers(agg: DataFrame, d_customer: DataFrame, as_of: dt.date) -> DataFrame:
    """Customer columns and recency of the RFM mart's aggregate."""
    c = d_customer.select("customer_id", "full_name", "store_id", "region_name_en")
    return c.join(agg, "customer_id").select(
        "customer_id", "full_name", "store_id", "region_name_en",
        F.datediff(F.lit(as_of), F.col("last_order_date")).alias("recency_days"),
        "frequency_orders", "monetary_value",
    )


def merchant_overview(d_merchant: DataFrame, d_store: DataFrame, fact_orders: DataFrame,
                      merchant_id: int | None = None) -> DataFrame:
    """Merchant LEFT JOIN stores LEFT JOIN orders; zeros when nothing joins.

    With ``merchant_id`` the filter reaches all three scans; an empty result
    means "not found".  Without it, every merchant (batch form).
    """
    m = d_merchant.select("merchant_id", "merchant_name", "subscription_plan", "status")
    st = d_store.select("store_id", "merchant_id")
    f = fact_orders.select("store_id", "order_id", "gross_amount", "net_amount")
    if merchant_id is not None:
        m = m.where(F.col("merchant_id") == merchant_id)
        st = st.where(F.col("merchant_id") == merchant_id)
    per_merchant = f.join(st, "store_id").groupBy("merchant_id").agg(
        F.sum("gross_amount").alias("g"), F.sum("net_amount").alias("n"),
        F.countDistinct("order_id").alias("o"))
    return m.join(per_merchant, "merchant_id", "left").select(
        "merchant_id", "merchant_name", "subscription_plan", "status",
        F.coalesce(F.col("g"), F.lit(0)).cast(DEC_SUM).alias("total_gmv_sar"),
        F.coalesce(F.col("n"), F.lit(0)).cast(DEC_SUM).alias("total_net_revenue_sar"),
        F.coalesce(F.col("o"), F.lit(0)).cast("long").alias("total_orders"),
    )


VAT_RATE = Decimal("0.15")
SHIPPING_FEE = Decimal("25.00")


def order_pricing(order_items: DataFrame, discount_rates: DataFrame) -> DataFrame:
    """Price an order from its items.

    gross = sum(items); discount = round(gross*rate, 2);
    vat = round((gross-discount)*0.15, 2); net = round(taxable + vat + 25, 2).
    """
    g = order_items.groupBy("order_id").agg(F.sum("total_price").cast(DEC_SUM).alias("gross_amount"))
    j = g.join(discount_rates, "order_id")
    disc = F.round(F.col("gross_amount") * F.col("discount_rate"), 2).cast(DEC_SUM)
    j = j.withColumn("discount_amount", disc)
    taxable = F.col("gross_amount") - F.col("discount_amount")
    j = j.withColumn("vat_amount", F.round(taxable * F.lit(VAT_RATE), 2).cast(DEC_SUM))
    return j.select(
        "order_id", "gross_amount", "discount_amount", "vat_amount",
        F.lit(SHIPPING_FEE).cast(DEC).alias("shipping_fee"),
        F.round(taxable + F.col("vat_amount") + F.lit(SHIPPING_FEE), 2).cast(DEC_SUM).alias("net_amount"),
    )


def lineage_rollup_region_gateway(order_wide: DataFrame) -> DataFrame:
    """Region x payment method: orders and GMV, largest GMV first."""
    return (
        order_wide.groupBy("merchant_region", "payment_method")
        .agg(F.count("order_id").alias("total_orders"),
             F.sum("order_amount_sar").cast(DEC_SUM).alias("regional_gmv"))
        .orderBy(F.desc("regional_gmv"), "merchant_region", "payment_method")
    )
