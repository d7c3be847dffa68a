"""Oracle SQL for the access log, streams, sources and sinks."""

AS_OF_TS = "TIMESTAMP '2001-08-02 00:00:00'"

REQUESTS = r"""
req AS (
  SELECT event_id AS log_id, 'USR-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS user_id,
         CASE WHEN event_type = 'error' THEN 'REJECTED' ELSE 'ACCEPTED' END AS consent_status,
         CASE WHEN event_id % 3 = 0 THEN NULL
              ELSE 'agent-' || CAST(event_id AS VARCHAR) || ' ' || repeat('x', CAST(event_id % 300 AS INTEGER)) END
           AS user_agent,
         CASE WHEN event_id % 4 = 0 THEN '' END AS h1,
         CASE WHEN event_id % 4 = 1 THEN '10.1.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR)
           END AS h2,
         CASE WHEN event_id % 4 IN (0, 2) THEN ' 10.2.' || CAST(user_id % 256 AS VARCHAR) || '.'
              || CAST(event_id % 256 AS VARCHAR) || ' , 172.16.0.' || CAST(event_id % 7 AS VARCHAR) END AS h3,
         CASE WHEN event_id % 4 = 3 THEN '' END AS h4,
         CASE WHEN event_id % 3 = 0 THEN 'ar-SA,ar;q=0.9' WHEN event_id % 3 = 1 THEN 'en-US' END AS accept_language,
         CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'User ' || CAST(user_id AS VARCHAR) END AS full_name,
         CASE WHEN event_id % 6 = 0 THEN 'bad-email' ELSE 'user' || CAST(user_id AS VARCHAR) || '@example.com' END AS email,
         '' AS country, ts AS login_time
  FROM events),
norm AS (
  SELECT log_id, user_id, consent_status,
         substring(COALESCE(user_agent, 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Desktop'), 1, 240) AS device_info,
         substring(COALESCE(NULLIF(trim(split_part(COALESCE(NULLIF(h1, ''), NULLIF(h2, ''), NULLIF(h3, ''),
                                                            NULLIF(h4, '')), ',', 1)), ''), '127.0.0.1'), 1, 40)
           AS ip_address,
         login_time,
         substring(COALESCE(NULLIF(trim(full_name), ''), 'Guest'), 1, 255) AS full_name,
         substring(COALESCE(trim(email), ''), 1, 255) AS email,
         COALESCE(regexp_matches(trim(email), '^[^@\s]+@[^@\s]+\.[^@\s]+$'), false) AS email_valid,
         substring(COALESCE(NULLIF(trim(country), ''), 'Unknown'), 1, 100) AS country,
         'Unknown' AS city, 'Unknown' AS region, 'Unknown' AS timezone,
         CASE WHEN lower(COALESCE(accept_language, 'en-US')) LIKE '%ar%' THEN 'ar' ELSE 'en' END AS preferred_language,
         'Consent ' || lower(consent_status) || ' via app' AS consent_notes
  FROM req)
"""

_MONEY = "CAST(ROUND(CAST(o_totalprice AS DECIMAL(12,2)) * 0.002, 2) AS DECIMAL(10,2))"
_COUNTS = """SELECT CAST(o_orderdate AS DATE) AS window_start, COUNT(*) AS orders,
       CAST(SUM(""" + _MONEY + """) AS DECIMAL(20,2)) AS gross_amount FROM orders"""

_TABLES = {
    "dw_dim_merchant": ("merchant_id", ["merchant_id", "merchant_name", "subscription_plan", "commercial_register_no",
                                        "vat_number", "status", "region_name_en", "joined_date"]),
    "dw_dim_store": ("store_id", ["store_id", "merchant_id", "store_name_en", "domain_url", "industry_category", "store_status"]),
    "dw_dim_customer": ("customer_id", ["customer_id", "store_id", "full_name", "phone_number", "gender", "region_name_en"]),
    "dw_dim_product": ("product_id", ["product_id", "store_id", "product_name_en", "category_name_en", "sku", "base_price",
                                      "cost_price", "current_stock"]),
    "dw_fact_sales": ("order_item_id", ["order_id", "order_item_id", "date_id", "store_id", "customer_id", "product_id",
                                        "quantity", "unit_price", "gross_sales", "item_cost", "gross_profit"]),
    "dw_fact_orders": ("order_id", ["order_id", "date_id", "store_id", "customer_id", "order_status", "payment_gateway",
                                    "courier_partner", "gross_amount", "discount_amount", "vat_amount", "shipping_fee",
                                    "net_amount"]),
}


def _content(name):
    key, cols = _TABLES[name]
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols)
    return (f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST(sum({key}) AS DECIMAL(20,0)) AS key_sum, "
            f"CAST(sum(('0x' || substr(md5({text}), 1, 8))::BIGINT) AS DECIMAL(20,0)) AS content_sum FROM {name}")


_CONTENTS = " UNION ALL ".join(_content(n) for n in _TABLES)


BODIES = {
    "access_log_normalize": "WITH " + REQUESTS + """
SELECT log_id, user_id, consent_status, device_info, ip_address, strftime(login_time, '%Y-%m-%d %H:%M:%S') AS login_time,
       full_name, email, email_valid, country, city, region, timezone, preferred_language, consent_notes FROM norm""",
    "audit_log_append": "WITH " + REQUESTS + """
SELECT log_id, user_id, consent_status, device_info, ip_address, strftime(login_time, '%Y-%m-%d %H:%M:%S') AS login_time,
       CASE WHEN legacy THEN NULL ELSE full_name END AS full_name, CASE WHEN legacy THEN NULL ELSE email END AS email,
       CASE WHEN legacy THEN NULL ELSE country END AS country, CASE WHEN legacy THEN NULL ELSE city END AS city,
       CASE WHEN legacy THEN NULL ELSE region END AS region, CASE WHEN legacy THEN NULL ELSE timezone END AS timezone,
       CASE WHEN legacy THEN NULL ELSE preferred_language END AS preferred_language,
       CASE WHEN legacy THEN NULL ELSE consent_notes END AS consent_notes
FROM (SELECT *, login_time < TIMESTAMP '2024-01-15 00:00:00' AS legacy FROM norm) x""",
    "stream_order_counts": _COUNTS + " GROUP BY 1",
    "stream_order_counts_append": _COUNTS + """
WHERE CAST(o_orderdate AS DATE) <= CAST((SELECT MAX(o_orderdate) FROM orders) AS DATE) - 2 GROUP BY 1""",
    "stream_purchase_counts": """
SELECT CAST(ts AS DATE) AS window_start, COUNT(*) AS purchases,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS purchase_value
FROM events WHERE event_type = 'purchase' GROUP BY 1""",
    "stream_purchase_counts_append": """
SELECT CAST(ts AS DATE) AS window_start, COUNT(*) AS purchases,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS purchase_value
FROM events WHERE event_type = 'purchase'
  AND CAST(ts AS DATE) + 1 <= CAST((SELECT MAX(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 1 DAY AS DATE)
GROUP BY 1""",
    "stream_dq_checks": f"""
SELECT order_id, reconciliation_fail, boundary_fail FROM (
  SELECT order_id,
         COALESCE(ABS(net_amount - (gross_amount - discount_amount + vat_amount + shipping_fee)) > 0.01, false)
           AS reconciliation_fail,
         COALESCE(net_amount < 0 OR gross_amount < 0 OR order_date > {AS_OF_TS}, false) AS boundary_fail
  FROM d_orders) x WHERE reconciliation_fail OR boundary_fail""",
    "stream_audit_state": f"""
WITH c AS (
  SELECT 'Financial Math Reconciliation (15% VAT + Fees)' AS check_name, order_id, order_date,
         coalesce(abs(net_amount - (gross_amount - discount_amount + vat_amount + shipping_fee)) > 0.01, false) AS failed FROM d_orders
  UNION ALL
  SELECT 'Boundary & Timestamp Validation Check', order_id, order_date,
         coalesce(net_amount < 0 OR gross_amount < 0 OR order_date > {AS_OF_TS}, false) FROM d_orders)
SELECT check_name, count(*) AS checked_records, count(*) FILTER (failed) AS failed_records,
       min(order_id) FILTER (failed) AS first_failed_order, max(order_date)::DATE AS latest_order,
       count(*) FILTER (failed) = 0 AS passed, CASE WHEN count(*) FILTER (failed) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM c GROUP BY check_name""",
    "stream_access_log": "WITH " + REQUESTS + """
SELECT DISTINCT user_id, consent_status, strftime(date_trunc('minute', login_time), '%Y-%m-%d %H:%M:%S') AS login_minute
FROM norm""",
    "scan_table": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "scan_whole_table": "SELECT * FROM supplier",
    "param_scan": """
SELECT date_id, order_id, payment_gateway, net_amount FROM dw_fact_orders
WHERE store_id = 7 AND date_id // 10000 IN (1996, 1997, 1998)""",
    "append_sink": "SELECT * FROM dw_fact_orders",
    "truncate_reload": _CONTENTS,
    "csv_lake_export": _CONTENTS,
    "parquet_lake_export": "SELECT * FROM dw_fact_orders",
    "ensure_tables": "SELECT * FROM dw_dim_store",
    "upsert_by_key": """
WITH it AS (SELECT order_item_id, order_id, line_number, product_id, quantity, unit_price, total_price,
                   CAST(l_shipdate AS DATE) AS d FROM d_order_items),
batch AS (SELECT * FROM it WHERE d >= DATE '1997-01-01'
          QUALIFY row_number() OVER (PARTITION BY order_id, line_number ORDER BY order_item_id DESC) = 1),
stored AS (SELECT * REPLACE (quantity + 1 AS quantity) FROM it WHERE d < DATE '1998-01-01'),
kept AS (SELECT * FROM stored WHERE (order_id, line_number) NOT IN (SELECT order_id, line_number FROM batch)
         UNION ALL SELECT * REPLACE (-order_id - 1 AS order_id) FROM stored)
SELECT * EXCLUDE (d) FROM batch UNION ALL SELECT * EXCLUDE (d) FROM kept""",
    "json_records": """
WITH earned AS (
  SELECT s.merchant_id, sum(x.g) AS g, sum(x.n) AS n, sum(x.k)::BIGINT AS k
  FROM (SELECT store_id, sum(gross_amount) AS g, sum(net_amount) AS n, count(order_id) AS k
        FROM dw_fact_orders GROUP BY store_id) x JOIN dw_dim_store s USING (store_id) GROUP BY s.merchant_id)
SELECT to_json({'merchant_id': merchant_id, 'merchant_name': merchant_name, 'subscription_plan': subscription_plan,
                'status': status, 'total_gmv_sar': ifnull(g, 0)::DECIMAL(20,2),
                'total_net_revenue_sar': ifnull(n, 0)::DECIMAL(20,2), 'total_orders': ifnull(k, 0)}) AS json
FROM dw_dim_merchant LEFT JOIN earned USING (merchant_id)""",
    "register_views": """
SELECT 'merchant_daily' AS view_name, count(*) AS row_count, sum(net)::DECIMAL(24,2) AS amount
FROM (SELECT store_id, date_id, sum(net_amount) AS net FROM dw_fact_orders GROUP BY ALL)
UNION ALL SELECT 'product_performance', count(DISTINCT product_id), sum(gross_sales)::DECIMAL(24,2) FROM dw_fact_sales
UNION ALL SELECT 'customer_rfm', count(DISTINCT customer_id), sum(net_amount)::DECIMAL(24,2) FROM dw_fact_orders
          WHERE customer_id IN (SELECT customer_id FROM dw_dim_customer)""",
}
