"""Declared business metrics.

The reference names these in its schema and documentation without code; the
definitions here are ours and are stated in each docstring.  Every one is a
grouping, join or window over the warehouse:

* grouped inputs are reduced with partial aggregates before any join or
  window, so hot keys are combined map-side;
* windows run over already-reduced frames (one row per entity and month or
  day), never over raw order rows;
* quantiles and ranks are exact but built from value histograms split
  into buckets (``functions.quantiles`` / ``functions.ranks``), never from
  holistic percentiles or unsplit group windows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_from_key
from ..functions.money import DEC_SUM, safe_ratio
from ..functions.quantiles import exact_quantiles
from ..functions.ranks import skew_safe_rank
from ..plans.warehouse import season_flags
from ..session import cut_lineage


def _order_day(fact_orders: DataFrame) -> DataFrame:
    return fact_orders.withColumn("order_day", date_from_key("date_id"))


# ---- X7 ----------------------------------------------------------------------
def session_funnel(sessions: DataFrame) -> DataFrame:
    """Sessions -> cart -> checkout, by channel and device."""
    g = sessions.groupBy("channel_source", "device_type").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("cart_added")).alias("carts"),
        F.count_if(F.col("checkout_started")).alias("checkouts"),
    )
    return g.select(
        "channel_source", "device_type", "sessions", "carts", "checkouts",
        safe_ratio(F.col("carts"), F.col("sessions")).alias("cart_rate"),
        safe_ratio(F.col("checkouts"), F.col("sessions")).alias("checkout_rate"),
        safe_ratio(F.col("checkouts"), F.col("carts")).alias("cart_to_checkout_rate"),
    )


# ---- X8 ----------------------------------------------------------------------
def campaign_roi(campaigns: DataFrame, fact_orders: DataFrame) -> DataFrame:
    """(net revenue of the campaign's store inside its dates - spend) / spend.

    Orders are first reduced to one row per store and day, so the
    store-and-date-range join sees at most one row per day and store.
    """
    daily = _order_day(fact_orders).groupBy("store_id", "order_day").agg(F.sum("net_amount").alias("net"))
    c = campaigns.select("campaign_id", "store_id", "channel", "ad_spend_sar", "start_date", "end_date")
    j = c.join(daily, (c.store_id == daily.store_id)
               & daily.order_day.between(c.start_date, c.end_date), "left").drop(daily.store_id)
    g = j.groupBy("campaign_id", "store_id", "channel", "ad_spend_sar").agg(
        F.coalesce(F.sum("net"), F.lit(0)).cast(DEC_SUM).alias("attributed_revenue"))
    return g.withColumn("roi", safe_ratio(F.col("attributed_revenue") - F.col("ad_spend_sar"), F.col("ad_spend_sar")))


# ---- X9 ----------------------------------------------------------------------
def customer_acquisition(fact_orders: DataFrame) -> DataFrame:
    """Month of the first order -> new customers."""
    first = fact_orders.groupBy("customer_id").agg(F.min("date_id").alias("d"))
    return (first.groupBy(F.trunc(date_from_key("d"), "month").alias("cohort_month"))
            .agg(F.count(F.lit(1)).alias("new_customers")))


# ---- X12 ---------------------------------------------------------------------
def _merchant_monthly(fact_orders: DataFrame, d_store: DataFrame) -> DataFrame:
    per_store = fact_orders.groupBy("store_id", F.trunc(date_from_key("date_id"), "month").alias("month")) \
        .agg(F.sum("gross_amount").alias("g"))
    return (per_store.join(d_store.select("store_id", "merchant_id"), "store_id")
            .groupBy("merchant_id", "month").agg(F.sum("g").cast(DEC_SUM).alias("gmv")))


def gmv_growth(fact_orders: DataFrame, d_store: DataFrame) -> DataFrame:
    """Month-over-month GMV growth per merchant (months with orders).

    growth = (gmv - previous month's gmv) / previous, NULL for the first
    month or a zero base.  The window runs over one row per merchant-month.
    """
    m = _merchant_monthly(fact_orders, d_store)
    w = Window.partitionBy("merchant_id").orderBy("month")
    prev = F.lag("gmv").over(w)
    return m.select("merchant_id", "month", "gmv", prev.alias("prev_gmv"),
                    safe_ratio(F.col("gmv") - prev, prev).alias("growth"))


def gmv_trajectory(fact_orders: DataFrame, d_store: DataFrame, as_of: dt.date, days: int = 90) -> DataFrame:
    """GMV of the last ``days`` before ``as_of`` vs the ``days`` before that."""
    d = date_from_key("date_id")
    lo1, lo2 = F.date_sub(F.lit(as_of), days), F.date_sub(F.lit(as_of), 2 * days)
    recent = F.when((d >= lo1) & (d < F.lit(as_of)), F.col("gross_amount"))
    prior = F.when((d >= lo2) & (d < lo1), F.col("gross_amount"))
    per_store = fact_orders.groupBy("store_id").agg(F.sum(recent).alias("r"), F.sum(prior).alias("p"))
    m = (d_store.select("store_id", "merchant_id").join(per_store, "store_id", "left")
         .groupBy("merchant_id").agg(F.coalesce(F.sum("r"), F.lit(0)).cast(DEC_SUM).alias("recent_gmv"),
                                     F.coalesce(F.sum("p"), F.lit(0)).cast(DEC_SUM).alias("prior_gmv")))
    return m.withColumn("gmv_growth", safe_ratio(F.col("recent_gmv") - F.col("prior_gmv"), F.col("prior_gmv")))


# ---- X13, X14 ------------------------------------------------------------------
def repeat_purchase_rate(fact_orders: DataFrame) -> DataFrame:
    """Per store, customers with >= 2 orders / customers with an order."""
    per_cust = fact_orders.groupBy("store_id", "customer_id").agg(F.countDistinct("order_id").alias("n"))
    g = per_cust.groupBy("store_id").agg(F.count(F.lit(1)).alias("customers"),
                                         F.count_if(F.col("n") >= 2).alias("repeat_customers"))
    return g.withColumn("repeat_purchase_rate", safe_ratio(F.col("repeat_customers"), F.col("customers")))


def customer_order_count(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Recompute customers.total_orders_count (always 0 at the source, Q17)."""
    n = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return customers.select("customer_id", "store_id").join(n, "customer_id", "left").select(
        "customer_id", "store_id", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("total_orders_count"))


# ---- X15 ------------------------------------------------------------------------
SEGMENT_RULES = [  # (label, condition on r, f, m scores 1..5)
    ("Champions", "r >= 4 AND f >= 4 AND m >= 4"),
    ("Loyal", "f >= 4"),
    ("Big Spenders", "m >= 4"),
    ("New", "r >= 4 AND f <= 2"),
    ("At Risk", "r <= 2 AND f >= 3"),
    ("Hibernating", "r <= 2"),
]


def customer_segments(rfm: DataFrame) -> DataFrame:
    """RFM quintile scores (1-5) and a segment label.

    Cut points are the exact 20/40/60/80 % quantiles (linear interpolation)
    of each measure over all customers, from :func:`exact_quantiles` with no
    group (value buckets keep every window small), entering as array-valued
    scalar subqueries: no cross join, no global ntile.  A customer scores
    1 + the number of cut points strictly below its value (recency
    reversed: recent scores high).  Labels follow ``SEGMENT_RULES`` in
    order, else 'Others'.
    """
    qs = {"c1": 0.2, "c2": 0.4, "c3": 0.6, "c4": 0.8}
    # the measures feed six subqueries and the scoring pass: materialise them
    # once (reliable checkpoint in the shared folder) instead of recomputing
    # the RFM pipeline for each
    rfm = cut_lineage(rfm.select("customer_id", "recency_days", "frequency_orders", "monetary_value"))

    def cuts(c):
        q = exact_quantiles(rfm, [], c, qs)
        return q.select(F.array(*[F.col(k) for k in qs])).scalar()

    def score(c, cut, reverse=False):
        above = sum((F.col(c).cast("double") > cut[i]).cast("int") for i in range(4))
        return (5 - above) if reverse else (above + 1)

    # each measure's cut points are bound once, so the plan holds one
    # subquery per measure however often the scores read them
    x = rfm.withColumns({"_rc": cuts("recency_days"), "_fc": cuts("frequency_orders"),
                         "_mc": cuts("monetary_value")})
    s = x.select("customer_id", "recency_days", "frequency_orders", "monetary_value",
                 score("recency_days", F.col("_rc"), reverse=True).alias("r"),
                 score("frequency_orders", F.col("_fc")).alias("f"),
                 score("monetary_value", F.col("_mc")).alias("m"))
    label = F.lit("Others")
    for name, cond in reversed(SEGMENT_RULES):
        label = F.when(F.expr(cond), name).otherwise(label)
    return s.select("customer_id", "recency_days", "frequency_orders", "monetary_value",
                    F.col("r").alias("r_score"), F.col("f").alias("f_score"), F.col("m").alias("m_score"),
                    label.alias("segment"))


# ---- X16 --------------------------------------------------------------------------
def retention_cohort(fact_orders: DataFrame) -> DataFrame:
    """First-order month x months since -> active customers.

    Orders are first reduced to distinct (customer, month) pairs, so the
    per-customer window sees at most one row per month.
    """
    cm = fact_orders.select("customer_id", F.trunc(date_from_key("date_id"), "month").alias("month")).distinct()
    cohort = F.min("month").over(Window.partitionBy("customer_id"))
    x = cm.withColumn("cohort_month", cohort)
    x = x.withColumn("months_since", F.months_between("month", "cohort_month").cast("int"))
    return x.groupBy("cohort_month", "months_since").agg(F.count("customer_id").alias("active_customers"))


# ---- X17, X18 ------------------------------------------------------------------------
def product_ranking(fact_sales: DataFrame, d_product: DataFrame) -> DataFrame:
    """Rank products by revenue within their store and category (1 = best).

    ``rank()`` semantics (ties share a rank) via :func:`skew_safe_rank`, so a
    store holding a third of all products is still ranked by many tasks.
    """
    rev = fact_sales.groupBy("product_id").agg(F.sum("gross_sales").cast(DEC_SUM).alias("revenue"))
    p = d_product.select("product_id", "store_id", "category_name_en").join(rev, "product_id")
    p = cut_lineage(p)  # ranked twice and read back twice: materialise once
    p = skew_safe_rank(p, ["store_id"], "revenue", descending=True, out="store_rank")
    p = skew_safe_rank(p, ["store_id", "category_name_en"], "revenue", descending=True, out="category_rank")
    return p.select("product_id", "store_id", "category_name_en", "revenue", "store_rank", "category_rank")


def category_performance(fact_sales: DataFrame, d_product: DataFrame) -> DataFrame:
    """Category -> units, revenue, profit, margin."""
    per_p = fact_sales.groupBy("product_id").agg(
        F.sum("quantity").alias("u"), F.sum("gross_sales").alias("r"), F.sum("gross_profit").alias("p"))
    g = (per_p.join(d_product.select("product_id", "category_name_en"), "product_id")
         .groupBy("category_name_en").agg(F.sum("u").cast("long").alias("units"),
                                          F.sum("r").cast(DEC_SUM).alias("revenue"),
                                          F.sum("p").cast(DEC_SUM).alias("gross_profit")))
    return g.withColumn("margin_pct", safe_ratio(F.col("gross_profit"), F.col("revenue")) * 100)


# ---- X19, X20 ---------------------------------------------------------------------------
def _trailing_units(fact_sales: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    d = date_from_key("date_id")
    return (fact_sales.where((d >= F.date_sub(F.lit(as_of), days)) & (d < F.lit(as_of)))
            .groupBy("product_id").agg(F.sum("quantity").cast("long").alias("units")))


def inventory_status(inventory: DataFrame, fact_sales: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Reorder flag (stock <= reorder level) and days of cover
    (stock / mean daily units over the trailing ``days``; NULL without sales)."""
    u = _trailing_units(fact_sales, as_of, days)
    inv = inventory.select("product_id", "stock_quantity", "reorder_level")
    return inv.join(u, "product_id", "left").select(
        "product_id", "stock_quantity", "reorder_level",
        (F.col("stock_quantity") <= F.col("reorder_level")).alias("needs_reorder"),
        F.coalesce(F.col("units"), F.lit(0)).cast("long").alias("units_sold"),
        safe_ratio(F.col("stock_quantity") * days, F.col("units")).alias("days_of_cover"),
    )


def declining_products(fact_sales: DataFrame, as_of: dt.date, days: int = 180) -> DataFrame:
    """Products whose revenue in the last ``days`` is below the ``days`` before."""
    d = date_from_key("date_id")
    lo1, lo2 = F.date_sub(F.lit(as_of), days), F.date_sub(F.lit(as_of), 2 * days)
    g = fact_sales.where((d >= lo2) & (d < F.lit(as_of))).groupBy("product_id").agg(
        F.coalesce(F.sum(F.when(d >= lo1, F.col("gross_sales"))), F.lit(0)).cast(DEC_SUM).alias("recent_revenue"),
        F.coalesce(F.sum(F.when(d < lo1, F.col("gross_sales"))), F.lit(0)).cast(DEC_SUM).alias("prior_revenue"))
    return g.where(F.col("recent_revenue") < F.col("prior_revenue")).withColumn(
        "change_pct", safe_ratio(F.col("recent_revenue") - F.col("prior_revenue"), F.col("prior_revenue")) * 100)


# ---- X21 - X24 --------------------------------------------------------------------------------
def delivery_performance(shipments: DataFrame) -> DataFrame:
    """By courier: shipments, delivered %, mean days shipped -> delivered."""
    days = F.datediff(F.col("delivered_at"), F.col("shipped_at"))
    g = shipments.groupBy("courier_partner").agg(
        F.count(F.lit(1)).alias("shipments"),
        F.count_if(F.col("shipment_status") == "Delivered").alias("delivered"),
        F.sum(days).alias("_d"), F.count(days).alias("_n"))
    return g.select("courier_partner", "shipments", "delivered",
                    (safe_ratio(F.col("delivered"), F.col("shipments")) * 100).alias("delivered_pct"),
                    safe_ratio(F.col("_d"), F.col("_n")).alias("avg_delivery_days"))


def return_rate(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Per store: orders with at least one return / orders."""
    r = returns.select("order_id").distinct().withColumn("_r", F.lit(1))
    j = orders.select("order_id", "store_id").join(r, "order_id", "left")
    g = j.groupBy("store_id").agg(F.count(F.lit(1)).alias("orders"), F.count("_r").alias("returned_orders"))
    return g.withColumn("return_rate", safe_ratio(F.col("returned_orders"), F.col("orders")))


def refund_by_reason(returns: DataFrame) -> DataFrame:
    """Refund amount and count by return reason."""
    return returns.groupBy("return_reason").agg(F.count(F.lit(1)).alias("returns"),
                                                F.sum("refund_amount").cast(DEC_SUM).alias("refund_amount"))


def review_rating_summary(reviews: DataFrame) -> DataFrame:
    """Product -> mean rating and review count."""
    g = reviews.groupBy("product_id").agg(F.sum("rating_score").alias("_s"), F.count("rating_score").alias("reviews"))
    return g.select("product_id", "reviews", safe_ratio(F.col("_s"), F.col("reviews")).alias("avg_rating"))


def support_ticket_summary(tickets: DataFrame) -> DataFrame:
    """Merchant x category x priority -> tickets and still-open tickets."""
    return tickets.groupBy("merchant_id", "category", "priority").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(F.col("ticket_status").isin("Open", "In_Progress")).alias("open_tickets"))


# ---- X25 - X28 ------------------------------------------------------------------------------------
def merchant_benchmark(fact_orders: DataFrame, d_store: DataFrame) -> DataFrame:
    """Store GMV vs the exact median store GMV of its industry."""
    g = fact_orders.groupBy("store_id").agg(F.sum("gross_amount").cast(DEC_SUM).alias("gmv"))
    s = d_store.select("store_id", "merchant_id", "industry_category").join(g, "store_id")
    med = exact_quantiles(s, ["industry_category"], "gmv", {"industry_median_gmv": 0.5}) \
        .select("industry_category", "industry_median_gmv")
    j = s.join(med, "industry_category")
    return j.select("store_id", "merchant_id", "industry_category", "gmv", "industry_median_gmv",
                    safe_ratio(F.col("gmv"), F.col("industry_median_gmv")).alias("vs_median"))


def coupon_usage(coupons: DataFrame, orders: DataFrame) -> DataFrame:
    """Coupon -> orders that used it inside its validity dates, discount given."""
    o = orders.where(F.col("coupon_id").isNotNull()).select(
        "coupon_id", F.to_date("order_date").alias("d"), "discount_amount")
    c = coupons.select("coupon_id", "store_id", "coupon_code", "start_date", "end_date")
    # one row per coupon and day before the join: a coupon on a third of the orders is combined map-side
    o = o.groupBy("coupon_id", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("discount_amount").alias("given"))
    j = c.join(o, (c.coupon_id == o.coupon_id) & o.d.between(c.start_date, c.end_date), "left").drop(o.coupon_id)
    return j.groupBy("coupon_id", "store_id", "coupon_code").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("uses"),
        F.coalesce(F.sum("given"), F.lit(0)).cast(DEC_SUM).alias("discount_given"))


def seasonal_sales(fact_orders: DataFrame) -> DataFrame:
    """Orders and GMV by weekend / Ramadan / national-day flags (of the calendar, W5)."""
    daily = fact_orders.groupBy("date_id").agg(F.count(F.lit(1)).alias("n"), F.sum("gross_amount").alias("g"))
    return (daily.withColumns(season_flags(date_from_key("date_id")))
            .groupBy("is_weekend", "is_ramadan_season", "is_national_day_season")
            .agg(F.sum("n").cast("long").alias("orders"), F.sum("g").cast(DEC_SUM).alias("gmv")))


def customer_churn_risk(fact_orders: DataFrame, as_of: dt.date) -> DataFrame:
    """Days since the last order vs the customer's mean gap between orders.

    mean_gap = (last - first) / (orders - 1); ratio = days_since / mean_gap;
    label: one order -> 'One-time', ratio > 2 -> 'At Risk', > 1 -> 'Cooling',
    else 'Active'.
    """
    d = date_from_key("date_id")
    g = fact_orders.groupBy("customer_id").agg(F.min(d).alias("first_order"), F.max(d).alias("last_order"),
                                               F.count(F.lit(1)).alias("orders"))
    gap = safe_ratio(F.datediff("last_order", "first_order"), F.col("orders") - 1)
    since = F.datediff(F.lit(as_of), F.col("last_order"))
    x = g.select("customer_id", "orders", since.alias("days_since_last"), gap.alias("mean_gap_days"))
    ratio = safe_ratio(F.col("days_since_last"), F.col("mean_gap_days"))
    x = x.withColumn("risk_ratio", ratio)
    label = (F.when(F.col("orders") <= 1, "One-time").when(F.col("risk_ratio") > 2, "At Risk")
             .when(F.col("risk_ratio") > 1, "Cooling").otherwise("Active"))
    return x.withColumn("risk_label", label)
