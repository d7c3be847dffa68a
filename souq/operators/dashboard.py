"""Dashboard queries (F1-F8 filters, B1-B16 panels) over the wide order view.

All panels are aggregates over ``order_wide``: filters are ``where``
clauses that Catalyst pushes through the view's joins to the scans, and
each panel returns tens of rows.  Shares of a total divide by a scalar
subquery over the grouped frame.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import DEC_SUM, safe_ratio
from ..functions.quantiles import five_number_summary

# ---------------------------------------------------------------------------
# Dashboard labels, coordinates and constants.
# ---------------------------------------------------------------------------
ALL_LABELS = {
    "merchant_region": "All Regions",
    "subscription_tier": "All Tiers",
    "store_category": "All Categories",
    "payment_method": "All Methods",
}
REGION_COORDS = {
    "Riyadh": (24.7136, 46.6753),
    "Makkah / Jeddah": (21.4858, 39.1925),
    "Eastern Province": (26.4207, 50.0888),
    "Asir": (18.2164, 42.5053),
    "Tabuk": (28.3835, 36.5662),
    "Qassim": (26.3260, 43.9750),
    "Madinah": (24.5247, 39.5692),
}
DEFAULT_COORDS = (24.7, 46.6)
NET_REVENUE_FACTOR = Decimal("0.95")
BNPL_WEIGHT = Decimal("0.35")
VAT_RATE = Decimal("0.15")
VAT_TOLERANCE = Decimal("1.0")
STATUS_COMPLIANT = "Compliant"
STATUS_FLAGGED = "Flagged Variance"
RISK_HIGH, RISK_MODERATE, RISK_HEALTHY = "High Churn Risk", "Moderate Risk", "Healthy"
RISK_THRESHOLDS = (0.6, 0.3)  # probability above -> high, above -> moderate
INTERVENTIONS = {
    RISK_HIGH: "Trigger BNPL Discount Promo",
    RISK_MODERATE: "Suggest Mada One-Click",
    RISK_HEALTHY: "Optimal Performance",
}


# ---- filters --------------------------------------------------------------
def filter_optional_conjunction(df: DataFrame, region: str | None = None, tier: str | None = None,
                                category: str | None = None, method: str | None = None,
                                dates: tuple[dt.date, ...] | None = None) -> DataFrame:
    """optional equalities ("All ..." or None disables one) and an
    inclusive order-date range applied only when two dates are given."""
    for col, val in (("merchant_region", region), ("subscription_tier", tier),
                     ("store_category", category), ("payment_method", method)):
        if val is not None and val != ALL_LABELS[col]:
            df = df.where(F.col(col) == val)
    if dates is not None and len(dates) == 2:
        df = df.where(F.col("order_date").between(F.lit(dates[0]), F.lit(dates[1])))
    return df


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """F8: the "All ..." entry followed by the distinct non-NULL values."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("option")).distinct()
    first = df.sparkSession.range(1).select(F.lit(ALL_LABELS.get(column, "All")).alias("option"))
    return (first.withColumn("position", F.lit(0))
            .unionByName(values.withColumn("position", F.lit(1)))
            .orderBy("position", "option"))


def filter_date_bounds(df: DataFrame) -> DataFrame:
    """F8: default date range = first and last order date."""
    return df.agg(F.min("order_date").alias("min_date"), F.max("order_date").alias("max_date"))


# ---- executive panels -------------------------------------------------------
def kpi_summary(df: DataFrame) -> DataFrame:
    """B1: GMV, net revenue (= GMV x 0.95, Q3), VAT, orders."""
    gmv = F.sum("order_amount_sar").cast(DEC_SUM)
    return df.agg(
        gmv.alias("gmv"),
        (gmv * F.lit(NET_REVENUE_FACTOR)).cast("decimal(24,4)").alias("net_revenue_estimate"),
        F.sum("vat_amount_sar").cast(DEC_SUM).alias("vat_collected"),
        F.count(F.lit(1)).alias("total_orders"),
    )


def merchant_leaderboard(df: DataFrame) -> DataFrame:
    """B2: merchant -> GMV and orders, largest GMV first (NULL names dropped)."""
    return (df.where(F.col("merchant_name").isNotNull()).groupBy("merchant_name")
            .agg(F.sum("order_amount_sar").cast(DEC_SUM).alias("total_gmv"),
                 F.count("order_amount_sar").alias("total_orders"))
            .orderBy(F.desc("total_gmv"), "merchant_name"))


def merchant_top_bottom(df: DataFrame) -> DataFrame:
    """Best and worst merchant of the leaderboard (ties: name order)."""
    lb = merchant_leaderboard(df)
    top = lb.orderBy(F.desc("total_gmv"), "merchant_name").limit(1).withColumn("position", F.lit("top"))
    low = lb.orderBy("total_gmv", F.desc("merchant_name")).limit(1).withColumn("position", F.lit("bottom"))
    return top.unionByName(low).select("position", "merchant_name", "total_gmv", "total_orders")


def revenue_by_region(df: DataFrame) -> DataFrame:
    """Region -> GMV."""
    return (df.where(F.col("merchant_region").isNotNull()).groupBy("merchant_region")
            .agg(F.sum("order_amount_sar").cast(DEC_SUM).alias("order_amount_sar")))


def payment_adoption(df: DataFrame) -> DataFrame:
    """Payment method -> orders."""
    return (df.where(F.col("payment_method").isNotNull()).groupBy("payment_method")
            .agg(F.count("order_id").alias("order_count")))


def monthly_gmv_trend(df: DataFrame) -> DataFrame:
    """Month-end -> GMV and VAT; months without orders are 0.

    The month axis is a sequence between the first and last month, taken
    from the grouped frame through scalar subqueries.
    """
    monthly = df.groupBy(F.last_day("order_date").alias("month")).agg(
        F.sum("order_amount_sar").alias("g"), F.sum("vat_amount_sar").alias("v"))
    lo = monthly.select(F.trunc(F.min("month"), "month")).scalar()
    hi = monthly.select(F.trunc(F.max("month"), "month")).scalar()
    months = (df.sparkSession.range(1)
              .select(F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 MONTH"))).alias("m"))
              .select(F.last_day("m").alias("month")))
    return months.join(monthly, "month", "left").select(
        "month",
        F.coalesce(F.col("g"), F.lit(0)).cast(DEC_SUM).alias("gmv"),
        F.coalesce(F.col("v"), F.lit(0)).cast(DEC_SUM).alias("vat"),
    )


def region_share_geo(df: DataFrame) -> DataFrame:
    """Region -> orders, GMV, share of orders %, map coordinates.

    Coordinates are a literal map lookup (no join) with a default.
    """
    g = (df.where(F.col("merchant_region").isNotNull()).groupBy("merchant_region")
         .agg(F.count("order_id").alias("order_count"),
              F.sum("order_amount_sar").cast(DEC_SUM).alias("order_amount_sar")))
    # total orders as a scalar subquery over the grouped frame (no
    # single-partition window)
    total = g.select(F.sum("order_count")).scalar()
    lat = F.create_map(*[x for k, (la, _) in REGION_COORDS.items() for x in (F.lit(k), F.lit(la))])
    lon = F.create_map(*[x for k, (_, lo) in REGION_COORDS.items() for x in (F.lit(k), F.lit(lo))])
    return g.select(
        "merchant_region", "order_count", "order_amount_sar",
        (F.col("order_count") / total * 100).alias("merchant_share_pct"),
        F.coalesce(lat[F.col("merchant_region")], F.lit(DEFAULT_COORDS[0])).alias("lat"),
        F.coalesce(lon[F.col("merchant_region")], F.lit(DEFAULT_COORDS[1])).alias("lon"),
    )


# ---- payment panels -----------------------------------------------------------
def gateway_matrix(df: DataFrame) -> DataFrame:
    """Method -> transactions, volume, mean order value."""
    return (df.where(F.col("payment_method").isNotNull()).groupBy("payment_method")
            .agg(F.count("order_amount_sar").alias("total_transactions"),
                 F.sum("order_amount_sar").cast(DEC_SUM).alias("volume_sar"),
                 safe_ratio(F.sum("order_amount_sar"), F.count("order_amount_sar")).alias("avg_order_value_sar")))


def bnpl_projection(df: DataFrame, boost_pct: int = 20) -> DataFrame:
    """Total volume x (1 + boost/100 x 0.35)."""
    factor = Decimal(1) + Decimal(boost_pct) / Decimal(100) * BNPL_WEIGHT
    vol = F.sum("order_amount_sar").cast(DEC_SUM)
    return df.where(F.col("payment_method").isNotNull()).agg(
        vol.alias("volume_sar"),
        F.lit(boost_pct).alias("boost_pct"),
        (vol * F.lit(factor)).cast("decimal(24,4)").alias("projected_gmv_sar"),
    )


def basket_distribution(df: DataFrame) -> DataFrame:
    """Method -> exact five-number summary of order value (box plot).

    Built from a (method, amount) histogram, so a method holding a third of
    all orders costs its number of distinct amounts, never its row count.
    """
    return five_number_summary(df.where(F.col("payment_method").isNotNull()), ["payment_method"],
                               "order_amount_sar")


def basket_distribution_approx(df: DataFrame, accuracy: int = 100000) -> DataFrame:
    """B10, sketch variant: ``percentile_approx`` keeps a bounded, mergeable
    summary per group (rank error 1/accuracy) for continuous values whose
    distinct count approaches the row count."""
    v = F.col("order_amount_sar").cast("double")
    q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
    return (df.where(F.col("payment_method").isNotNull()).groupBy("payment_method")
            .agg(F.min(v).alias("min"), q.alias("_q"), F.max(v).alias("max"), F.count(v).alias("n"))
            .select("payment_method", "n", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                    F.col("_q")[2].alias("q3"), "max"))


def gateway_scatter(df: DataFrame) -> DataFrame:
    """Method -> volume, transactions, volume / transactions."""
    g = (df.where(F.col("payment_method").isNotNull()).groupBy("payment_method")
         .agg(F.sum("order_amount_sar").cast(DEC_SUM).alias("volume_sar"),
              F.count("order_id").alias("transactions")))
    return g.withColumn("avg_order_value_sar", safe_ratio(F.col("volume_sar"), F.col("transactions")))


# ---- VAT compliance -------------------------------------------------------------
def vat_audit_ledger(df: DataFrame, status: str | None = None, region: str | None = None) -> DataFrame:
    """B12 (+F4): expected VAT = 15 % of the taxable amount, variance, status.

    Every order is audited (Q14); status Compliant when |variance| < 1.0.
    """
    expected = (F.col("order_amount_sar") * F.lit(VAT_RATE)).cast("decimal(14,4)")
    variance = (F.col("vat_amount_sar") - expected).cast("decimal(14,4)")
    out = df.select(
        F.col("order_id").alias("invoice_reference"),
        F.col("merchant_name").alias("store_identifier"),
        F.col("merchant_region").alias("region"),
        "order_date",
        F.col("order_amount_sar").alias("net_amount_sar"),
        F.col("vat_amount_sar").alias("collected_vat_sar"),
        expected.alias("verified_vat_sar"),
        variance.alias("vat_variance"),
        F.when(F.abs(variance) < F.lit(VAT_TOLERANCE), STATUS_COMPLIANT).otherwise(STATUS_FLAGGED).alias("audit_status"),
    )
    if status is not None:
        out = out.where(F.col("audit_status") == status)
    if region is not None:
        out = out.where(F.col("region") == region)
    return out


def vat_audit_status_counts(ledger: DataFrame) -> DataFrame:
    """Audit status -> invoices, most frequent first (value_counts)."""
    return (ledger.groupBy("audit_status").agg(F.count(F.lit(1)).alias("invoice_count"))
            .orderBy(F.desc("invoice_count"), "audit_status"))


def vat_variance_histogram(ledger: DataFrame, width: Decimal = Decimal("0.25")) -> DataFrame:
    """Fixed-width variance bins anchored at 0 (bin k = [k*w, (k+1)*w))."""
    k = F.floor(F.col("vat_variance") / F.lit(width))
    return (ledger.where(F.col("vat_variance").isNotNull()).groupBy(k.cast("long").alias("bin"))
            .agg(F.count(F.lit(1)).alias("invoice_count"))
            .select("bin", (F.col("bin") * F.lit(width)).cast("decimal(20,2)").alias("bin_start"),
                    ((F.col("bin") + 1) * F.lit(width)).cast("decimal(20,2)").alias("bin_end"), "invoice_count"))


# ---- merchant risk ------------------------------------------------------------------
def risk_level(p: Column) -> Column:
    hi, mid = RISK_THRESHOLDS
    return F.when(p > hi, RISK_HIGH).when(p > mid, RISK_MODERATE).otherwise(RISK_HEALTHY)


def intervention(risk: Column) -> Column:
    return (F.when(risk == RISK_HIGH, INTERVENTIONS[RISK_HIGH])
            .when(risk == RISK_MODERATE, INTERVENTIONS[RISK_MODERATE]).otherwise(INTERVENTIONS[RISK_HEALTHY]))


def merchant_risk_table(health: DataFrame, growth: DataFrame, churn: DataFrame,
                        risk: str | None = None, min_health: float = 0.0) -> DataFrame:
    """B15 (+F3): per merchant health score, GMV trajectory, churn probability,
    risk level (> 0.6 high, > 0.3 moderate) and the recommended intervention.

    ``health`` (merchant_id, health_score), ``growth`` (merchant_id,
    gmv_growth), ``churn`` (merchant_id, merchant_name, churn_probability).
    """
    t = (churn.join(health, "merchant_id", "left").join(growth, "merchant_id", "left")
         .withColumn("risk_status", risk_level(F.col("churn_probability"))))
    t = t.withColumn("recommended_intervention", intervention(F.col("risk_status")))
    if risk is not None:
        t = t.where(F.col("risk_status") == risk)
    if min_health:
        t = t.where(F.col("health_score") >= min_health)
    return t.select("merchant_id", "merchant_name", "health_score", "gmv_growth", "churn_probability",
                    "risk_status", "recommended_intervention")


def risk_level_counts(risk_table: DataFrame) -> DataFrame:
    """Risk status -> merchants, most frequent first (value_counts)."""
    return (risk_table.groupBy("risk_status").agg(F.count(F.lit(1)).alias("merchants"))
            .orderBy(F.desc("merchants"), "risk_status"))
