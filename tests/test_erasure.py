"""Erasure in stored tables: only hit partitions change, all tables or none."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from souq.operators.quality import erase
from souq.plans import build as BLD
from souq.plans import erasure as ER
from souq.plans import stored_marts as SM
from souq.queries import star_for
from souq.sources import stored as ST
from souq.sources.adapter import OLTP_TABLES

from .conftest import SMOKE_DIR
from .test_stored import Crash, Failing


@pytest.fixture(scope="module")
def star(spark):
    return star_for(spark, SMOKE_DIR)


def store(spark, star, base, warehouse=True):
    ER.store_operational(spark, base, {t: star.d.table(t) for t in OLTP_TABLES})
    if warehouse:
        BLD.build_warehouse(star, base)


def rows(df):
    return sorted(map(repr, df.collect()))


def all_files(base):
    return {t: sorted(os.path.join(d, f) for d, _, fs in os.walk(f"{base}/{t}") for f in fs if f.endswith(".parquet"))
            for t in sorted(os.listdir(base)) if not t.startswith("_")}


def test_erasure_equals_the_frames_and_spares_the_rest(spark, star, tmp_path):
    base = str(tmp_path)
    store(spark, star, base)
    SM.refresh(spark, base)
    before = all_files(base)
    gone = star.d.customers.where("customer_id = 11").select("customer_id")
    done = ER.erase_stored(spark, base, "customers", gone)
    want = erase({t: star.d.table(t) for t in OLTP_TABLES}, "customers", gone)
    for t, df in want.items():
        assert rows(ER.read_stored(spark, base, t).select(df.columns)) == rows(df), t
    after = all_files(base)
    assert {t for t in before if before[t] != after[t]} == set(done)
    assert "merchants" not in done and "products" not in done and "dw_dim_product" not in done
    for t, parts in done.items():
        column = BLD.MONTH_COL if t in BLD.FACTS else ER.PART
        if parts:
            hit = tuple(f"{base}/{t}/{column}={p}/" for p in parts)
            assert [f for f in before[t] if not f.startswith(hit)] == [f for f in after[t] if not f.startswith(hit)]
            if t != "customer_sessions":  # all of one month
                assert len(parts) < len({os.path.dirname(f) for f in before[t]})
    # the warehouse holds nothing made from what went, and the marts follow those months
    orders = ER.read_stored(spark, base, "orders")
    ws = BLD.WrittenStar(spark, base, star.as_of)
    for fact in (ws.fact_orders, ws.fact_sales):
        assert fact.where("customer_id = 11").count() == 0
        assert fact.join(orders, "order_id", "left_anti").count() == 0
    assert ws.dim_customer.where("customer_id = 11").count() == 0
    months = sorted(set(done["dw_fact_orders"]) | set(done["dw_fact_sales"]))
    assert SM.refresh(spark, base) == months
    assert SM.StoredMarts(spark, base).customer_rfm(star.as_of).where("customer_id = 11").count() == 0
    # once more: nothing left to do, no file changes
    settled = all_files(base)
    assert ER.erase_stored(spark, base, "customers", gone) == {} and all_files(base) == settled
    assert ER.erase_stored(spark, base, "customers", gone.where("1 = 0")) == {} and all_files(base) == settled


def small(spark, base):
    """Few tables, so that every interruption point can be tried."""
    customers = spark.createDataFrame([(i, 1, None) for i in range(4)], "customer_id long, store_id long, region_id long")
    orders = spark.createDataFrame([(i, 1, i % 4, None, f"199{i % 3}-05-01") for i in range(12)],
                                   "order_id long, store_id long, customer_id long, coupon_id long, d string") \
        .withColumn("order_date", F.to_timestamp("d")).drop("d")
    sessions = spark.createDataFrame([(i, 1, i % 5, "1995-01-01" if i % 2 else None) for i in range(10)],
                                     "session_id long, store_id long, customer_id long, d string") \
        .withColumn("session_date", F.to_timestamp("d")).drop("d")
    ER.store_operational(spark, base, {"customers": customers, "orders": orders, "customer_sessions": sessions})


def content(spark, base):
    return {t: rows(ER.read_stored(spark, base, t)) for t in ("customers", "orders", "customer_sessions")}


def test_an_interrupted_erasure_is_whole_or_has_not_happened(spark, tmp_path):
    gone = spark.createDataFrame([(3,), (99,), (None,)], "customer_id long")
    small(spark, str(tmp_path / "all"))
    before = content(spark, str(tmp_path / "all"))
    assert ER.erase_stored(spark, str(tmp_path / "all"), "customers", gone) == {
        "customers": [], "customer_sessions": [0, 199501], "orders": [199005, 199105, 199205]}
    after = content(spark, str(tmp_path / "all"))
    assert not any("customer_id=3" in r for t in after.values() for r in t)
    assert len(after["customer_sessions"]) == 10 and len(after["orders"]) == 9
    seen = set()
    small(spark, str(tmp_path / "fresh"))
    for n in range(60):
        base = str(tmp_path / str(n))
        shutil.copytree(tmp_path / "fresh", base)
        try:
            ER.erase_stored(spark, base, "customers", gone, Failing(spark, base, n))
            done = True
        except Crash:
            done = False
        now = content(spark, base)  # reading recovers
        assert now in (before, after)
        if done or (now == after) not in seen:  # once more, from either state
            ER.erase_stored(spark, base, "customers", gone)
            assert content(spark, base) == after
        seen.add(now == after)
        if done:
            break
    assert done and seen == {True, False}


def test_the_lookup_reads_keys_alone(spark, tmp_path):
    small(spark, str(tmp_path))
    orders = ER.read_stored(spark, str(tmp_path), "orders")
    plan = orders.select("order_id", ER.PART)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_id:bigint>" in plan
    assert ST.stale_partitions(spark, str(tmp_path)) == set()
