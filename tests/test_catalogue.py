"""Catalogue tables with bucketed facts, and distinct counts from merged sketches."""

import os

import pytest
from pyspark.sql import functions as F

from souq.operators import registrations as R
from souq.plans import catalogue as CAT
from souq.plans import stored_marts as SM
from souq.queries import star_for
from souq.session import setting
from souq.sources.sinks import WAREHOUSE_SCHEMAS

from .conftest import SMOKE_DIR


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_stored_sales_and_orders_meet_without_a_shuffle(spark, tmp_path, no_broadcast):
    s = star_for(spark, SMOKE_DIR)
    t = CAT.save_catalogue(s, str(tmp_path / "w"), "souq_test_a", buckets=4)
    sales, orders = spark.table(t["dw_fact_sales"]), spark.table(t["dw_fact_orders"])
    plan = final_plan(CAT.order_margins(sales, orders))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    over_gateways = final_plan(CAT.gateway_margins(sales, orders))
    assert over_gateways.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(payment_gateway" in over_gateways
    plain = final_plan(CAT.order_margins(s.fact_sales, s.fact_orders))
    assert "Exchange hashpartitioning(order_id" in plain
    want = CAT.order_margins(s.fact_sales, s.fact_orders)
    assert CAT.order_margins(sales, orders).exceptAll(want).count() == 0
    for name, schema in WAREHOUSE_SCHEMAS.items():
        stored = spark.table(t[name])
        assert [(f.name, f.dataType) for f in stored.schema.fields] == [(f.name, f.dataType) for f in schema.fields]
        assert stored.count() == s.tables()[name].count()


def test_lines_are_dealt_out_once_on_their_way_into_buckets(spark, no_broadcast):
    s = star_for(spark, SMOKE_DIR)
    orders = s.d.orders.select("order_id", "store_id")
    with setting(spark, "spark.sql.shuffle.partitions", "4"):
        plan = final_plan(s.d.order_items_dealt(4).join(orders, "order_id").repartition(4, "order_id"))
    assert "Window" in plan and "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 2  # the lines, and the orders they meet
    dealt, plain = s.tables_by_order(4), s.tables()
    assert dealt.keys() == plain.keys()
    assert dealt["dw_fact_sales"].exceptAll(plain["dw_fact_sales"]).count() == 0
    assert plain["dw_fact_sales"].exceptAll(dealt["dw_fact_sales"]).count() == 0


def test_the_number_of_buckets_follows_the_lines(spark, monkeypatch):
    s = star_for(spark, SMOKE_DIR)
    lines = s.d.raw("lineitem").count()
    monkeypatch.setattr(CAT, "ROWS_PER_BUCKET", lines // 11)
    t = R._catalogued(s)
    for fact in ("dw_fact_sales", "dw_fact_orders"):
        assert f"INTO {-(-lines // (lines // 11))} BUCKETS" in spark.sql(f"SHOW CREATE TABLE {t[fact]}").first()[0]
    assert spark.table(t["dw_fact_sales"]).exceptAll(s.fact_sales).count() == 0
    assert spark.table(t["dw_fact_sales"]).count() == s.fact_sales.count()


def test_definitions_follow_the_files(spark, tmp_path):
    s = star_for(spark, SMOKE_DIR)
    base = str(tmp_path / "w")
    empty = CAT.ensure_catalogue(spark, base, "souq_test_b", buckets=3)
    assert all(spark.table(n).count() == 0 for n in empty.values())
    assert "INTO 3 BUCKETS" in spark.sql(f"SHOW CREATE TABLE {empty['dw_fact_orders']}").first()[0]
    CAT.save_catalogue(s, base, "souq_test_b", buckets=5)
    n = s.fact_orders.count()
    # another session's catalogue: defined again over the same files, whatever number it asks for
    again = CAT.ensure_catalogue(spark, base, "souq_test_c", buckets=16)
    assert "INTO 5 BUCKETS" in spark.sql(f"SHOW CREATE TABLE {again['dw_fact_orders']}").first()[0]
    assert spark.table(again["dw_fact_orders"]).count() == n
    assert CAT.ensure_catalogue(spark, base, "souq_test_c", buckets=16) == again
    assert spark.table(again["dw_fact_orders"]).count() == n
    more = CAT.save_catalogue(s, base, "souq_test_c", buckets=2)
    assert "INTO 2 BUCKETS" in spark.sql(f"SHOW CREATE TABLE {more['dw_fact_sales']}").first()[0]
    key = spark.table(more["dw_fact_sales"]).select("order_id").first()[0]
    assert spark.table(more["dw_fact_sales"]).where(F.col("order_id") == key).count() == s.fact_sales.where(F.col("order_id") == key).count()
    assert not os.path.exists(f"{base}/_staging")


def test_sketches_merge_to_any_grain(spark):
    rows = [(19960101 + d, st, st * 1000 + d * 40 + i, (st * 7 + i * (d + 1)) % 900) for st in range(3) for d in range(28) for i in range(40)]
    fact = spark.createDataFrame(rows, "date_id int, store_id long, order_id long, customer_id long") \
        .withColumn("order_month", F.lit(199601)).withColumn("net_amount", F.lit(1).cast("decimal(10,2)"))
    for c in ("gross_amount", "discount_amount", "vat_amount"):
        fact = fact.withColumn(c, F.col("net_amount"))
    sales = spark.createDataFrame([], "order_month int, product_id long, quantity int, gross_sales decimal(10,2), "
                                      "item_cost decimal(10,2), gross_profit decimal(10,2)")
    part = SM.partials(fact, sales)["mart_part_distinct"]
    assert part.count() == 84
    for keys in (["store_id"], ["date_id"], []):
        near = {tuple(r[:-2]): (r.o, r.c) for r in part.groupBy(*keys).agg(
            F.hll_sketch_estimate(F.hll_union_agg("order_sketch")).alias("o"),
            F.hll_sketch_estimate(F.hll_union_agg("customer_sketch")).alias("c")).collect()}
        exact = {tuple(r[:-2]): (r.o, r.c) for r in fact.groupBy(*keys).agg(
            F.countDistinct("order_id").alias("o"), F.countDistinct("customer_id").alias("c")).collect()}
        assert set(near) == set(exact)
        for k in exact:
            for a, b in zip(near[k], exact[k]):
                assert abs(a - b) <= 0.5 + 5 * 1.04 / 2 ** 7 * b
        # customers come back on other days: adding up daily counts would be far off
    days = fact.groupBy("store_id", "date_id").agg(F.countDistinct("customer_id").alias("c")).agg(F.sum("c")).first()[0]
    assert days > 2 * fact.select("customer_id").distinct().count()
