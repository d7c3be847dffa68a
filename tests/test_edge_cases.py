"""Edge cases on tiny hand-made frames (FIXTURES.md section 5)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from souq.operators import dashboard as B
from souq.operators import quality as G
from souq.operators import semantic as L
from souq.plans import marts as M
from souq.plans import warehouse as W

from .conftest import df_of

ORDERS_DDL = ("order_id long, store_id long, customer_id long, coupon_id long, order_number string, "
              "order_status string, gross_amount decimal(10,2), discount_amount decimal(10,2), "
              "vat_amount decimal(10,2), shipping_fee decimal(10,2), net_amount decimal(10,2), order_date timestamp")
PAY_DDL = "payment_id long, order_id long, payment_gateway string"
SHIP_DDL = "shipment_id long, order_id long, courier_partner string"
T0 = dt.datetime(2024, 3, 5)


def order(oid, store=1, gross="100.00", disc="0.00", vat="15.00", ship="25.00", net="140.00", when=T0):
    return (oid, store, 10, None, f"N{oid}", "Delivered", D(gross), D(disc), D(vat), D(ship), D(net), when)


@pytest.fixture
def orders(spark):
    return df_of(spark, [order(1), order(2), order(3, store=2)], ORDERS_DDL)


def test_fact_orders_keeps_last_payment_and_defaults(spark, orders):
    pay = df_of(spark, [(10, 1, "Mada"), (11, 1, "Tabby")], PAY_DDL)
    ship = df_of(spark, [(20, 1, "SMSA"), (21, 1, "Aramex"), (22, 3, "Flow")], SHIP_DDL)
    f = {r.order_id: r for r in W.fact_orders(orders, pay, ship).collect()}
    assert len(f) == 3  # no fan-out from duplicate payments or shipments
    assert f[1].payment_gateway == "Tabby" and f[1].courier_partner == "Aramex"
    assert f[2].payment_gateway == "Unpaid" and f[2].courier_partner == "Unshipped"
    assert f[3].payment_gateway == "Unpaid" and f[3].courier_partner == "Flow"
    assert f[1].date_id == 20240305


def test_dim_product_defaults(spark):
    prods = df_of(spark, [(1, 1, None, "a", "s1", D("10.00"), D("5.50")), (2, 1, 7, "b", "s2", D("3.00"), D("1.00"))],
                  "product_id long, store_id long, category_id long, product_name_en string, sku string, "
                  "base_price decimal(10,2), cost_price decimal(10,2)")
    cats = df_of(spark, [(7, "Toys")], "category_id long, category_name_en string")
    inv = df_of(spark, [(1, 2, 9), (2, 2, 4)], "inventory_id long, product_id long, stock_quantity int")
    p = {r.product_id: r for r in W.dim_product(prods, cats, inv).collect()}
    assert p[1].category_name_en == "General" and p[1].current_stock == 0
    assert p[2].category_name_en == "Toys" and p[2].current_stock == 4  # last inventory row wins


def test_mart_drops_dates_outside_calendar(spark):
    fact = df_of(spark, [(1, 20240101, 1, 10, D("10.00"), D("0"), D("1.5"), D("25"), D("36.5")),
                         (2, 20300101, 1, 10, D("10.00"), D("0"), D("1.5"), D("25"), D("36.5"))],
                 "order_id long, date_id int, store_id long, customer_id long, gross_amount decimal(10,2), "
                 "discount_amount decimal(10,2), vat_amount decimal(10,2), shipping_fee decimal(10,2), "
                 "net_amount decimal(10,2)")
    st = df_of(spark, [(1, 5, "Electronics")], "store_id long, merchant_id long, industry_category string")
    m = df_of(spark, [(5, "M", "Pro")], "merchant_id long, merchant_name string, subscription_plan string")
    cal = W.dim_date(spark, dt.date(2024, 1, 1), dt.date(2026, 12, 31))
    assert sorted(r.date_id for r in M.mart_merchant_daily(fact, st, m).collect()) == [20240101, 20300101]
    out = M.mart_merchant_daily(fact, st, m, cal).collect()
    assert [r.date_id for r in out] == [20240101]


def test_dim_date_flags(spark):
    d = {r.full_date: r for r in W.dim_date(spark, dt.date(2024, 9, 12), dt.date(2024, 9, 16)).collect()}
    fri = d[dt.date(2024, 9, 13)]
    assert fri.is_weekend and fri.day_of_week == "Friday" and fri.quarter == "Q3"
    assert not d[dt.date(2024, 9, 14)].is_national_day_season and d[dt.date(2024, 9, 15)].is_national_day_season
    assert d[dt.date(2024, 9, 15)].date_id == 20240915 and not d[dt.date(2024, 9, 15)].is_ramadan_season


def test_overview_zeros_for_merchant_without_store(spark):
    m = df_of(spark, [(1, "A", "Basic", "Active"), (2, "B", "Pro", "Churned")],
              "merchant_id long, merchant_name string, subscription_plan string, status string")
    st = df_of(spark, [(10, 1), (11, 1)], "store_id long, merchant_id long")
    f = df_of(spark, [(10, 100, D("5.00"), D("6.00"))],
              "store_id long, order_id long, gross_amount decimal(10,2), net_amount decimal(10,2)")
    out = {r.merchant_id: r for r in M.merchant_overview(m, st, f).collect()}
    assert out[2].total_orders == 0 and out[2].total_gmv_sar == 0
    assert out[1].total_orders == 1 and out[1].total_net_revenue_sar == D("6.00")
    assert M.merchant_overview(m, st, f, merchant_id=99).count() == 0  # "not found"


def test_margin_null_on_zero_revenue(spark):
    fs = df_of(spark, [(1, 1, D("0.00"), D("0.00"), D("0.00"))],
               "product_id long, quantity int, gross_sales decimal(10,2), item_cost decimal(10,2), "
               "gross_profit decimal(10,2)")
    p = df_of(spark, [(1, "x", "General", 1)], "product_id long, product_name_en string, category_name_en string, "
                                               "store_id long")
    r = M.mart_product_performance(fs, p).first()
    assert r.profit_margin_pct is None


def test_health_score_null_guard(spark):
    fs = df_of(spark, [(1, 1, D("0.00")), (2, 2, None), (2, 3, None), (3, 4, D("1000.00"))],
               "store_id long, order_id long, gross_sales decimal(10,2)")
    out = {r.store_id: r.merchant_health_score
           for r in L.compile_metric({"dw_fact_sales": fs}, "merchant_health_score").collect()}
    assert out[1] is None                      # sum 0: log10 undefined -> NULL
    assert out[2] == pytest.approx(0.2)        # NULL sum counts as 1: 0.1 x 2 orders
    assert out[3] == pytest.approx(60.1)       # 3 x 20 + 0.1


def test_unknown_metric_and_column(spark):
    fs = df_of(spark, [(1, 1, D("1.00"))], "store_id long, order_id long, gross_sales decimal(10,2)")
    with pytest.raises(ValueError):
        L.compile_metric({"dw_fact_sales": fs}, "no_such_metric")
    with pytest.raises(ValueError):
        L.compile_metric({"dw_fact_sales": fs}, "gmv", group_by="merchant_id")
    assert L.metric_catalog({}) == {}


def _wide(spark, rows):
    return df_of(spark, rows, "order_id long, order_date date, order_amount_sar decimal(10,2), "
                              "vat_amount_sar decimal(10,2), payment_method string, merchant_name string, "
                              "merchant_region string, subscription_tier string, store_category string")


def test_monthly_trend_zero_fills_gaps(spark):
    w = _wide(spark, [(1, dt.date(2024, 1, 5), D("10"), D("1.5"), "Mada", "A", "Riyadh", "Pro", "X"),
                      (2, dt.date(2024, 3, 9), D("20"), D("3"), "Mada", "A", "Riyadh", "Pro", "X")])
    t = {r.month: r.gmv for r in B.monthly_gmv_trend(w).collect()}
    assert t == {dt.date(2024, 1, 31): D("10.00"), dt.date(2024, 2, 29): D("0.00"), dt.date(2024, 3, 31): D("20.00")}


def test_dashboard_drops_null_keys_and_defaults_coords(spark):
    w = _wide(spark, [(1, dt.date(2024, 1, 5), D("10"), D("1.5"), None, "A", None, "Pro", "X"),
                      (2, dt.date(2024, 1, 6), D("30"), D("4.5"), "Mada", "B", "Riyadh", "Pro", "X"),
                      (3, dt.date(2024, 1, 7), D("10"), D("1.5"), "COD", "C", "Atlantis", "Pro", "X")])
    assert {r.payment_method for r in B.payment_adoption(w).collect()} == {"Mada", "COD"}
    geo = {r.merchant_region: r for r in B.region_share_geo(w).collect()}
    assert set(geo) == {"Riyadh", "Atlantis"}
    assert (geo["Atlantis"].lat, geo["Atlantis"].lon) == (24.7, 46.6)
    assert geo["Riyadh"].lat == 24.7136
    assert sum(r.merchant_share_pct for r in geo.values()) == pytest.approx(100.0)


def test_vat_audit_strict_tolerance(spark):
    # expected VAT = 15 % of 100.00 = 15.0000; variances 0.99, 1.00, -1.01
    w = _wide(spark, [(1, dt.date(2024, 1, 1), D("100.00"), D("15.99"), "Mada", "A", "R", "P", "X"),
                      (2, dt.date(2024, 1, 1), D("100.00"), D("16.00"), "Mada", "A", "R", "P", "X"),
                      (3, dt.date(2024, 1, 1), D("100.00"), D("13.99"), "Mada", "A", "R", "P", "X")])
    s = {r.invoice_reference: r.audit_status for r in B.vat_audit_ledger(w).collect()}
    assert s == {1: "Compliant", 2: "Flagged Variance", 3: "Flagged Variance"}


def test_reconciliation_strict_tolerance(spark):
    o = df_of(spark, [order(1, net="140.01"), order(2, net="140.02"), order(3)], ORDERS_DDL)
    r = G.dq_financial_reconciliation(o).first()
    assert r.failed_records == 1 and r.status == "FAIL"


def test_orphans_and_scorecard(spark, orders):
    items = df_of(spark, [(1, 1), (2, 99)], "order_item_id long, order_id long")
    pay = df_of(spark, [(1, 1, "Mada"), (2, 77, "COD"), (3, 78, "COD")], PAY_DDL)
    fact = orders.select("order_id")
    r = G.dq_referential_integrity(items, pay, orders).first()
    assert r.failed_records == 3
    card = {r.check_name: r for r in G.dq_scorecard(orders, items, pay, fact, dt.date(2030, 1, 1)).collect()}
    assert card["Referential Integrity Audit (Foreign Key Links)"].failed_records == 3
    assert {r.score_pct for r in card.values()} == {75.0}


def test_boundary_future_dates(spark):
    o = df_of(spark, [order(1, when=dt.datetime(2031, 1, 1)), order(2, net="-1.00"), order(3)], ORDERS_DDL)
    assert G.dq_boundary(o, dt.date(2030, 1, 1)).first().failed_records == 2


def test_upsert_idempotent_last_row_wins(spark):
    ddl = "k long, v string, ver long"
    target = df_of(spark, [(1, "old", 1), (2, "keep", 1)], ddl)
    batch = df_of(spark, [(1, "new", 5), (1, "newer", 6), (3, "add", 1)], ddl)
    once = W.upsert_by_key(target, batch, ["k"], "ver")
    twice = W.upsert_by_key(once, batch, ["k"], "ver")
    rows = sorted(tuple(r) for r in twice.collect())
    assert rows == [(1, "newer", 6), (2, "keep", 1), (3, "add", 1)]
    assert sorted(tuple(r) for r in once.collect()) == rows


def test_propagate_delete(spark):
    child = df_of(spark, [(1, 10), (2, 11), (3, None)], "id long, parent long")
    gone = df_of(spark, [(10,)], "parent long")
    assert sorted(r.id for r in G.propagate_delete(child, "parent", gone, "C").collect()) == [2, 3]
    nulled = {r.id: r.parent for r in G.propagate_delete(child, "parent", gone, "N").collect()}
    assert nulled == {1: None, 2: 11, 3: None}


def test_filters_and_options(spark):
    w = _wide(spark, [(1, dt.date(2024, 1, 5), D("10"), D("1.5"), "Mada", "A", "Riyadh", "Pro", "X"),
                      (2, dt.date(2024, 2, 5), D("10"), D("1.5"), "COD", "B", "Asir", "Basic", "Y")])
    assert B.filter_optional_conjunction(w, region="All Regions", dates=(dt.date(2024, 1, 1),)).count() == 2
    assert B.filter_optional_conjunction(w, region="Asir").count() == 1
    assert B.filter_optional_conjunction(w, dates=(dt.date(2024, 1, 1), dt.date(2024, 1, 5))).count() == 1
    assert [r.option for r in B.filter_options(w, "merchant_region").collect()] == ["All Regions", "Asir", "Riyadh"]


def test_top_bottom_merchant(spark):
    w = _wide(spark, [(1, dt.date(2024, 1, 5), D("10"), D("1"), "Mada", "A", "R", "P", "X"),
                      (2, dt.date(2024, 1, 5), D("30"), D("1"), "Mada", "B", "R", "P", "X"),
                      (3, dt.date(2024, 1, 5), D("5"), D("1"), "Mada", "C", "R", "P", "X")])
    tb = {r.position: r.merchant_name for r in B.merchant_top_bottom(w).collect()}
    assert tb == {"top": "B", "bottom": "C"}


def test_fk_audit_skips_null_keys(spark):
    tables = {
        "stores": df_of(spark, [(1, 1)], "store_id long, merchant_id long"),
        "orders": df_of(spark, [(1, 1, None), (2, 9, 5)], "order_id long, store_id long, coupon_id long"),
        "coupons": df_of(spark, [(5, 1)], "coupon_id long, store_id long"),
    }
    from souq.operators.quality import orphan_count
    assert orphan_count(tables["orders"], "store_id", tables["stores"], "store_id").first().n == 1
    assert orphan_count(tables["orders"], "coupon_id", tables["coupons"], "coupon_id").first().n == 0
