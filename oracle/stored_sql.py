"""Oracle SQL for stored tables after loads and erasures: what they must hold in the end."""

from .growth_sql import DAY

AS_OF = "DATE '2001-08-02'"

_MART_DAILY = """
SELECT store_id, merchant_id, merchant_name, subscription_plan, industry_category, date_id,
       strptime(date_id::VARCHAR, '%Y%m%d')::DATE AS full_date, count(DISTINCT order_id) AS total_orders,
       sum(gross_amount)::DECIMAL(20,2) AS gross_merchandise_value, sum(discount_amount)::DECIMAL(20,2) AS total_discounts,
       sum(vat_amount)::DECIMAL(20,2) AS total_vat_collected, sum(net_amount)::DECIMAL(20,2) AS net_revenue,
       sum(net_amount)::DOUBLE / count(net_amount) AS average_order_value
FROM dw_fact_orders JOIN dw_dim_store USING (store_id) JOIN dw_dim_merchant USING (merchant_id) GROUP BY ALL"""

_MART_PRODUCT = """
SELECT product_id, product_name_en, category_name_en, p.store_id, sum(quantity)::BIGINT AS total_units_sold,
       sum(gross_sales)::DECIMAL(20,2) AS total_gross_revenue, sum(item_cost)::DECIMAL(20,2) AS total_cogs,
       sum(gross_profit)::DECIMAL(20,2) AS total_gross_profit,
       sum(gross_profit)::DOUBLE / nullif(sum(gross_sales)::DOUBLE, 0) * 100 AS profit_margin_pct
FROM dw_fact_sales JOIN dw_dim_product p USING (product_id) GROUP BY ALL"""

_MART_RFM = f"""
SELECT customer_id, full_name, c.store_id, region_name_en, datediff('day', max({DAY}), {AS_OF})::INTEGER AS recency_days,
       count(DISTINCT order_id) AS frequency_orders, sum(net_amount)::DECIMAL(20,2) AS monetary_value
FROM dw_fact_orders JOIN dw_dim_customer c USING (customer_id) GROUP BY ALL"""

BODIES = {
    "warehouse_month_load": "SELECT * FROM dw_fact_orders",
    "warehouse_month_load_sales": "SELECT * FROM dw_fact_sales",
    "warehouse_touched_months": """
WITH late AS (SELECT DISTINCT date_id // 100 AS m FROM dw_fact_orders WHERE date_id >= 20010601),
moved AS (SELECT count(*) AS n FROM dw_fact_orders WHERE date_id // 100 = 199602 AND order_id % 5 = 0),
months AS (SELECT m FROM late UNION SELECT unnest([199512, 199602]) FROM moved WHERE n > 0)
SELECT table_name, m::INTEGER AS order_month, m IN (SELECT date_id // 100 FROM dw_fact_orders) AS has_orders
FROM months, (VALUES ('dw_fact_orders'), ('dw_fact_sales'), ('mart partials')) t(table_name)""",
    "kept_mart_merchant_daily": _MART_DAILY,
    "kept_mart_product_performance": _MART_PRODUCT,
    "kept_mart_customer_rfm": _MART_RFM,
}

_GONE = """
gone AS (SELECT customer_id FROM d_customers WHERE customer_id % 300 = 7),
gone_orders AS (SELECT order_id FROM d_orders WHERE customer_id IN (SELECT customer_id FROM gone))"""


def _touched(table: str, at: str, hit: str) -> str:
    place = f"coalesce(strftime({at}, '%Y%m')::INTEGER, 0)"
    return (f"SELECT '{table}' AS table_name, (SELECT count(DISTINCT {place}) FROM d_{_SHORT.get(table, table)} WHERE {hit})::INTEGER AS rewritten, "
            f"(SELECT count(DISTINCT {place}) FROM d_{_SHORT.get(table, table)})::INTEGER AS partitions")


_SHORT = {"customer_sessions": "sessions"}
_BY_ORDER = "order_id IN (SELECT order_id FROM gone_orders)"

BODIES |= {
    "erase_stored_orders": f"WITH {_GONE} SELECT order_id, customer_id, coupon_id, net_amount FROM d_orders "
                           "WHERE customer_id NOT IN (SELECT customer_id FROM gone)",
    "erase_stored_items": f"WITH {_GONE} SELECT order_item_id, order_id, total_price FROM d_order_items "
                          "WHERE order_id NOT IN (SELECT order_id FROM gone_orders)",
    "erase_stored_sessions": f"WITH {_GONE} SELECT session_id, store_id, CASE WHEN customer_id NOT IN (SELECT customer_id FROM gone) "
                             "THEN customer_id END AS customer_id FROM d_sessions",
    "erase_stored_fact_sales": f"WITH {_GONE} SELECT order_item_id, order_id, customer_id, gross_sales FROM dw_fact_sales "
                               "WHERE order_id NOT IN (SELECT order_id FROM gone_orders)",
    "erase_stored_partitions": f"WITH {_GONE} SELECT * FROM (" + " UNION ALL ".join([
        _touched("orders", "order_date", _BY_ORDER), _touched("order_items", "l_shipdate", _BY_ORDER),
        _touched("payments", "paid_at", _BY_ORDER), _touched("shipments", "shipped_at", _BY_ORDER),
        _touched("returns", "requested_at", _BY_ORDER),
        _touched("customer_sessions", "session_date", "customer_id IN (SELECT customer_id FROM gone)")]) + ") x WHERE rewritten > 0",
}

BODIES |= {
    "bucketed_gateway_margins": """
SELECT payment_gateway, count(DISTINCT order_id) AS orders, count(*) AS lines, sum(quantity)::BIGINT AS units,
       sum(gross_profit)::DECIMAL(20,2) AS gross_profit,
       (sum(gross_profit) - (SELECT sum(o.discount_amount) FROM dw_fact_orders o WHERE o.payment_gateway = x.payment_gateway
                               AND o.order_id IN (SELECT order_id FROM dw_fact_sales)))::DECIMAL(20,2) AS margin
FROM dw_fact_sales JOIN (SELECT order_id, payment_gateway FROM dw_fact_orders) x USING (order_id) GROUP BY payment_gateway""",
    "bucketed_dim_store": "SELECT * FROM dw_dim_store",
    "distinct_by_sketch": """
WITH f AS (SELECT o.order_id, o.customer_id, o.store_id, o.date_id, s.industry_category
           FROM dw_fact_orders o JOIN dw_dim_store s ON s.store_id = o.store_id)
SELECT grain, value, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers,
       true AS orders_within_error, true AS customers_within_error
FROM (SELECT 'store_id' AS grain, store_id::VARCHAR AS value, * FROM f
      UNION ALL SELECT 'order_month', (date_id // 100)::VARCHAR, * FROM f
      UNION ALL SELECT 'industry_category', industry_category, * FROM f
      UNION ALL SELECT 'all', 'all', * FROM f) x GROUP BY grain, value""",
}
