"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each builds the domain and star lazily over the whole driver tables; only
the columns a query touches are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import marts as M
from .plans import warehouse as W
from .plans.star import Star
from .sources.adapter import Domain

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


_STARS: dict = {}


def star_for(spark: SparkSession, sf_dir: str) -> Star:
    """One lazy star (logical plans only, no data) per session and directory.

    Plans are immutable, so queries share the already-built dimension and
    fact plans instead of rebuilding them through the JVM gateway.  The key
    holds the directory's size and file count (one file-system call), so data
    added later is never planned with counts of the old.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    now = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at)
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, now.getLength(), now.getFileCount())
    if key not in _STARS:
        # dates, day windows and date keys are defined in UTC (the driver's
        # timestamps carry no zone)
        if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        _STARS[key] = Star(Domain(spark, sf_dir))
    return _STARS[key]


def register(name: str):
    def deco(fn: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(star_for(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


# ---- warehouse ------------------------------------------------------------
register("dim_merchant")(lambda s: s.dim_merchant)
register("dim_store")(lambda s: s.dim_store)
register("dim_customer")(lambda s: s.dim_customer)
register("dim_product")(lambda s: s.dim_product)
# the calendar's horizon is derived from the orders inside the plan
register("dim_date")(lambda s: W.dim_date_for(s.d.orders))
register("fact_sales")(lambda s: s.fact_sales)
register("fact_orders")(lambda s: s.fact_orders)
register("order_wide")(lambda s: s.order_wide)

# ---- marts ------------------------------------------------------------------
register("mart_merchant_daily")(
    lambda s: M.mart_merchant_daily(s.fact_orders, s.dim_store, s.dim_merchant))
register("mart_product_performance")(lambda s: M.mart_product_performance(s.fact_sales, s.dim_product))
register("mart_customer_rfm")(
    lambda s: M.mart_customer_rfm(s.dim_customer, s.fact_orders, s.as_of))
register("merchant_overview")(lambda s: M.merchant_overview(s.dim_merchant, s.dim_store, s.fact_orders))
register("order_pricing")(lambda s: M.order_pricing(s.d.order_items, s.d.order_discount_rates))
register("lineage_rollup_region_gateway")(lambda s: M.lineage_rollup_region_gateway(s.order_wide))


def queries() -> dict[str, QueryFn]:
    # import the operator modules for their registrations
    from .operators import registrations  # noqa: F401
    return dict(REGISTRY)
