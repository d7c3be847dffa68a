
from pyspark.sql import functions as F

from souq.operators import dashboard as B
from souq.plans import build as BLD
from souq.queries import star_for
from souq.sources import sinks as S

from .conftest import SMOKE_DIR


def test_fact_row_counts(spark):
    s = star_for(spark, SMOKE_DIR)
    d = s.d
    known = (d.order_items.join(d.orders.select("order_id"), "order_id", "left_semi")
             .join(d.products.select("product_id"), "product_id", "left_semi"))
    assert s.fact_sales.count() == known.count()
    assert s.fact_orders.count() == d.orders.count()
    assert s.fact_orders.select("order_id").distinct().count() == d.orders.count()


def test_item_ids_unique_and_within_their_order(spark):
    it = star_for(spark, SMOKE_DIR).d.order_items
    assert it.select("order_item_id").distinct().count() == it.count()
    assert it.where("order_item_id <= order_id * 10000000 or order_item_id >= (order_id + 1) * 10000000").count() == 0


def test_share_sums_to_100(spark):
    r = B.region_share_geo(star_for(spark, SMOKE_DIR).order_wide).agg(F.sum("merchant_share_pct")).first()[0]
    assert abs(r - 100.0) < 1e-9


def test_written_facts_prune_month_partitions(spark):
    s = star_for(spark, SMOKE_DIR)
    base = S.work_path(spark, "tests", "wh")
    BLD.build_warehouse(s, base)
    ws = BLD.WrittenStar(spark, base, s.as_of)
    df = ws.fact_orders_between(199703, 199706)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "order_month" in plan
    assert df.count() == s.fact_orders.where(F.floor(F.col("date_id") / 100).between(199703, 199706)).count()
