"""The domain adapter written as DuckDB common table expressions."""

# Fixed vocabularies as SQL list literals (same values as the adapter).
_GATEWAYS = "['Mada','STC_Pay','Apple_Pay','Credit_Card','Tabby','Tamara','COD']"
_COURIERS = "['SMSA','Aramex','Saudi_Post','Flow','Imile']"
_INDUSTRIES = ("['Abayas & Fashion','Oud & Perfumes','Saudi Dates & Sweets',"
               "'Electronics','Beauty & Cosmetics','Home & Kitchen']")
_CHANNELS = "['Instagram','Snapchat','TikTok','Google_Ads','SMS','WhatsApp']"
_DEVICES = "['Mobile_iOS','Mobile_Android','Desktop','Tablet']"
_GENDERS = "['Male','Female','Unspecified']"
_REASONS = "['Defective','Wrong_Item','Size_Fit_Issue','Changed_Mind','Delayed_Delivery']"
_RSTATUS = "['Requested','Approved','Rejected','Refunded']"
_TCAT = "['Payment_Issue','Shipping_Delay','App_Integration','Domain_Setting','Billing']"
_TPRI = "['Low','Medium','High','Urgent']"
_TSTAT = "['Open','In_Progress','Resolved','Closed']"
_SCHAN = "['Direct','Instagram','Google','TikTok','Snapchat']"


def _money(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(12,2)) * 0.002, 2) AS DECIMAL(10,2))"


CTES = f"""
p_sizes AS (
  SELECT (SELECT count(*) FROM supplier) AS n_m,
         ((SELECT count(*) FROM supplier) * 6) // 5 AS n_s,
         (SELECT count(*) FROM part) AS n_p,
         (SELECT count(*) FROM customer) AS n_c
),
d_regions AS (
  SELECT CAST(r_regionkey AS BIGINT) AS region_id, r_name AS region_name_en
  FROM region
),
d_merchants AS (
  SELECT s.s_suppkey AS merchant_id, s.s_name AS merchant_name,
         CASE WHEN s.s_suppkey % 20 < 10 THEN 'Basic' WHEN s.s_suppkey % 20 < 17 THEN 'Plus' ELSE 'Pro' END
           AS subscription_plan,
         '1' || lpad(CAST(s.s_suppkey AS VARCHAR), 9, '0') AS commercial_register_no,
         '3' || lpad(CAST(s.s_suppkey AS VARCHAR), 14, '0') AS vat_number,
         CASE WHEN s.s_suppkey % 10 = 3 THEN 'Churned' WHEN s.s_suppkey % 20 = 7 THEN 'Suspended'
              WHEN s.s_suppkey % 50 = 11 THEN 'Pending_Verification' ELSE 'Active' END AS status,
         DATE '1995-01-01' + CAST(s.s_suppkey * 7 % 1500 AS INTEGER) AS joined_date,
         CAST(n.n_regionkey AS BIGINT) AS region_id,
         'merchant_' || CAST(s.s_suppkey AS VARCHAR) || '@example.com' AS email
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
),
d_stores AS (
  SELECT store_id, merchant_id,
         'Store ' || CAST(store_id AS VARCHAR) AS store_name_en,
         'https://store-' || CAST(store_id + 100 AS VARCHAR) || '.example.sa' AS domain_url,
         ({_INDUSTRIES})[store_id % 6 + 1] AS industry_category,
         CASE WHEN store_id % 20 = 19 THEN 'Maintenance' WHEN store_id % 25 = 24 THEN 'Inactive' ELSE 'Live' END
           AS store_status
  FROM (
    SELECT CAST(s_suppkey AS BIGINT) AS store_id,
           CASE WHEN s_suppkey % 50 = 49 THEN s_suppkey - 1 ELSE s_suppkey END AS merchant_id
    FROM supplier
    UNION ALL
    SELECT CAST(s_suppkey + (SELECT n_m FROM p_sizes) AS BIGINT), s_suppkey
    FROM supplier WHERE s_suppkey < (SELECT n_s - n_m FROM p_sizes)
  ) x
),
d_customers AS (
  SELECT c.c_custkey AS customer_id,
         CAST(c.c_custkey % (SELECT n_s FROM p_sizes) AS BIGINT) AS store_id,
         c.c_name AS full_name,
         CASE WHEN c.c_custkey % 25 = 0 THEN NULL ELSE 'customer' || CAST(c.c_custkey AS VARCHAR) || '@example.com' END
           AS email,
         '+9665' || lpad(CAST(c.c_custkey % 100000000 AS VARCHAR), 8, '0') AS phone_number,
         CAST(n.n_regionkey AS BIGINT) AS region_id,
         ({_GENDERS})[c.c_custkey % 3 + 1] AS gender
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
),
d_categories AS (
  SELECT p_partkey AS category_id, CAST(p_partkey % (SELECT n_s FROM p_sizes) AS BIGINT) AS store_id,
         p_type AS category_name_en, CAST(NULL AS BIGINT) AS parent_category_id
  FROM part WHERE p_partkey % 50 <> 0
),
d_products AS (
  SELECT p_partkey AS product_id,
         CAST(p_partkey % (SELECT n_s FROM p_sizes) AS BIGINT) AS store_id,
         CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey END AS category_id,
         p_name AS product_name_en,
         'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS sku,
         {_money('p_retailprice')} AS base_price,
         CAST(ROUND({_money('p_retailprice')} * 0.55, 2) AS DECIMAL(10,2)) AS cost_price
  FROM part
),
d_inventory AS (
  SELECT p_partkey AS inventory_id, p_partkey AS product_id,
         CAST(p_partkey * 37 % 500 AS INTEGER) AS stock_quantity,
         CAST(p_partkey % 16 + 5 AS INTEGER) AS reorder_level
  FROM part WHERE p_partkey % 40 <> 7
),
d_coupons AS (
  SELECT store_id AS coupon_id, store_id,
         CASE WHEN store_id % 2 = 0 THEN 'Percentage' ELSE 'Fixed_SAR' END AS discount_type,
         CAST(CASE WHEN store_id % 2 = 0 THEN 10.00 ELSE 5.00 END AS DECIMAL(10,2)) AS discount_value,
         DATE '1995-01-01' + CAST(store_id * 53 % 2000 AS INTEGER) AS start_date,
         DATE '1995-01-01' + CAST(store_id * 53 % 2000 AS INTEGER) + 180 AS end_date
  FROM d_stores
),
d_campaigns AS (
  SELECT store_id AS campaign_id, store_id,
         ({_CHANNELS})[store_id % 6 + 1] AS channel,
         CAST((store_id % 20) * 25 + 50 AS DECIMAL(10,2)) AS ad_spend_sar,
         DATE '1995-01-01' + CAST(store_id * 37 % 2000 AS INTEGER) AS start_date,
         DATE '1995-01-01' + CAST(store_id * 37 % 2000 AS INTEGER) + 30 AS end_date
  FROM d_stores
),
o_money AS (
  SELECT o.*,
         CASE o_orderkey % 3 WHEN 0 THEN 0.00 WHEN 1 THEN 0.10 ELSE 0.15 END AS discount_rate,
         {_money('o_totalprice')} AS gross_amount
  FROM orders o
),
o_money2 AS (
  SELECT *, CAST(ROUND(gross_amount * discount_rate, 2) AS DECIMAL(10,2)) AS discount_amount FROM o_money
),
o_money3 AS (
  SELECT *,
         CAST(ROUND((gross_amount - discount_amount) * 0.15, 2)
              + CASE WHEN o_orderkey % 97 = 0 THEN 2.00 ELSE 0.00 END AS DECIMAL(10,2)) AS vat_amount,
         CAST(25.00 AS DECIMAL(10,2)) AS shipping_fee
  FROM o_money2
),
o_priced AS (
  SELECT *,
         CAST(gross_amount - discount_amount + vat_amount + shipping_fee
              + CASE WHEN o_orderkey % 101 = 0 THEN 1.00 ELSE 0.00 END AS DECIMAL(10,2)) AS net_amount
  FROM o_money3
),
d_orders AS (
  SELECT o_orderkey AS order_id,
         CAST(o_orderkey % (SELECT n_s FROM p_sizes) AS BIGINT) AS store_id,
         o_custkey AS customer_id,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % (SELECT n_s FROM p_sizes) AS BIGINT) END
           AS coupon_id,
         'ORD-SAU-' || CAST(o_orderkey + 100000 AS VARCHAR) AS order_number,
         CASE WHEN o_orderstatus = 'P' THEN 'Pending' WHEN o_orderstatus = 'F' THEN 'Delivered'
              WHEN o_orderkey % 5 = 0 THEN 'Processing' WHEN o_orderkey % 5 = 3 THEN 'Returned'
              WHEN o_orderkey % 5 = 4 THEN 'Cancelled' ELSE 'Shipped' END AS order_status,
         gross_amount, discount_amount, vat_amount, shipping_fee, net_amount,
         o_orderdate AS order_date, discount_rate
  FROM o_priced
),
d_order_items AS (
  SELECT l_orderkey * 10000000 + (l_partkey + l_suppkey + l_linenumber) % 256 + 1
         + 256 * (row_number() OVER (
             PARTITION BY l_orderkey, (l_partkey + l_suppkey + l_linenumber) % 256
             ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
                      l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1) AS order_item_id,
         l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         {_money('l_extendedprice')} AS unit_price,
         CAST({_money('l_extendedprice')} * CAST(l_quantity AS INTEGER) AS DECIMAL(10,2)) AS total_price,
         l_returnflag, l_shipdate, l_linenumber AS line_number
  FROM lineitem
),
d_payments AS (
  SELECT o_orderkey * 2 + seq AS payment_id,
         CASE WHEN o_orderkey % 1009 = 5 THEN -o_orderkey - 1 ELSE o_orderkey END AS order_id,
         ({_GATEWAYS})[(o_orderkey + seq) % 7 + 1] AS payment_gateway,
         CASE WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Success' END AS payment_status,
         'TXN-' || CAST(o_orderkey * 2 + seq AS VARCHAR) AS transaction_reference,
         net_amount AS amount_paid,
         o_orderdate + to_days(CAST(seq AS INTEGER)) AS paid_at
  FROM o_priced, (SELECT 0 AS seq UNION ALL SELECT 1) s
  WHERE o_orderkey % 17 <> 0 AND (seq = 0 OR o_orderkey % 13 = 0)
),
d_shipments AS (
  SELECT o_orderkey * 2 + seq AS shipment_id, o_orderkey AS order_id,
         ({_COURIERS})[(o_orderkey + seq) % 5 + 1] AS courier_partner,
         'TRK-' || CAST(o_orderkey * 2 + seq AS VARCHAR) AS tracking_number,
         CASE WHEN o_orderstatus = 'F' THEN 'Delivered' ELSE 'In_Transit' END AS shipment_status,
         o_orderdate + INTERVAL 1 DAY AS shipped_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 4 + 2 AS INTEGER)) END
           AS delivered_at
  FROM orders, (SELECT 0 AS seq UNION ALL SELECT 1) s
  WHERE o_orderstatus <> 'P' AND (seq = 0 OR o_orderkey % 11 = 0)
),
d_returns AS (
  SELECT order_item_id AS return_id, order_id, product_id,
         ({_REASONS})[order_id % 5 + 1] AS return_reason,
         total_price AS refund_amount,
         ({_RSTATUS})[order_id % 4 + 1] AS return_status,
         l_shipdate + INTERVAL 7 DAY AS requested_at
  FROM d_order_items WHERE l_returnflag = 'R'
),
d_sessions AS (
  SELECT event_id AS session_id,
         CAST(user_id % (SELECT n_s FROM p_sizes) AS BIGINT) AS store_id,
         user_id AS customer_id,
         ({_DEVICES})[event_id % 4 + 1] AS device_type,
         ({_SCHAN})[event_id % 5 + 1] AS channel_source,
         CAST(event_id % 9 + 1 AS INTEGER) AS pages_viewed,
         event_type IN ('click', 'purchase') AS cart_added,
         event_type = 'purchase' AS checkout_started,
         ts AS session_date
  FROM events
),
d_tickets AS (
  SELECT event_id AS ticket_id,
         CAST(user_id % (SELECT n_m FROM p_sizes) AS BIGINT) AS merchant_id,
         ({_TCAT})[event_id % 5 + 1] AS category,
         ({_TPRI})[event_id % 4 + 1] AS priority,
         ({_TSTAT})[(event_id + 1) % 4 + 1] AS ticket_status,
         ts AS created_at
  FROM events WHERE event_type = 'error'
),
d_reviews AS (
  SELECT doc_id AS review_id,
         CAST(doc_id % (SELECT n_p FROM p_sizes) AS BIGINT) AS product_id,
         CAST(doc_id % (SELECT n_c FROM p_sizes) AS BIGINT) AS customer_id,
         CAST(quality * 2 + (1 - toxic) * 2 + 1 AS INTEGER) AS rating_score,
         TIMESTAMP '2001-01-01 00:00:00' AS created_at
  FROM labels
),
dw_dim_merchant AS (
  SELECT merchant_id, merchant_name, subscription_plan, commercial_register_no, vat_number, status,
         (SELECT any_value(region_name_en) FROM d_regions r WHERE r.region_id = d_merchants.region_id) AS region_name_en,
         joined_date
  FROM d_merchants
),
dw_dim_store AS (
  SELECT store_id, merchant_id, store_name_en, domain_url, industry_category, store_status FROM d_stores
),
dw_dim_customer AS (
  SELECT customer_id, store_id, full_name, phone_number, gender,
         (SELECT any_value(region_name_en) FROM d_regions r WHERE r.region_id = d_customers.region_id) AS region_name_en
  FROM d_customers
),
dw_dim_product AS (
  SELECT product_id, store_id, product_name_en, ifnull(cat.name, 'General') AS category_name_en, sku, base_price, cost_price,
         ifnull(stock.q, 0) AS current_stock
  FROM d_products
  LEFT JOIN (SELECT category_id, category_name_en AS name FROM d_categories) cat USING (category_id)
  LEFT JOIN (SELECT product_id, stock_quantity AS q FROM d_inventory) stock USING (product_id)
),
order_head AS (
  SELECT order_id, store_id, customer_id,
         (year(order_date) * 10000 + month(order_date) * 100 + day(order_date))::INTEGER AS date_id FROM d_orders
),
dw_fact_sales AS (
  SELECT order_id, order_item_id, date_id, store_id, customer_id, product_id, quantity, unit_price, gross_sales,
         item_cost::DECIMAL(10,2) AS item_cost, (gross_sales - item_cost)::DECIMAL(10,2) AS gross_profit
  FROM (SELECT order_id, order_item_id, product_id, quantity, unit_price, total_price AS gross_sales,
               cost_price * quantity AS item_cost
        FROM d_order_items NATURAL JOIN (SELECT product_id, cost_price FROM d_products))
  NATURAL JOIN order_head
),
pay_way AS (SELECT order_id, arg_max(payment_gateway, payment_id) AS payment_gateway FROM d_payments GROUP BY order_id),
ship_way AS (SELECT order_id, arg_max(courier_partner, shipment_id) AS courier_partner FROM d_shipments GROUP BY order_id),
dw_fact_orders AS (
  SELECT order_id, date_id, store_id, customer_id, order_status, ifnull(payment_gateway, 'Unpaid') AS payment_gateway,
         ifnull(courier_partner, 'Unshipped') AS courier_partner, gross_amount, discount_amount, vat_amount, shipping_fee,
         net_amount
  FROM d_orders NATURAL JOIN order_head LEFT JOIN pay_way USING (order_id) LEFT JOIN ship_way USING (order_id)
),
dim_date_x AS (
  SELECT CAST(d AS DATE) AS full_date FROM generate_series(
    CAST(date_trunc('year', (SELECT min(order_date) FROM d_orders)) AS TIMESTAMP),
    CAST(date_trunc('year', (SELECT max(order_date) FROM d_orders)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS TIMESTAMP),
    INTERVAL 1 DAY) g(d)
),
dim_date_t AS (
  SELECT CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_id, full_date,
         dayname(full_date) AS day_of_week, CAST(day(full_date) AS INTEGER) AS day_number,
         CAST(month(full_date) AS INTEGER) AS month_number, monthname(full_date) AS month_name,
         'Q' || CAST(quarter(full_date) AS VARCHAR) AS quarter, CAST(year(full_date) AS INTEGER) AS year,
         isodow(full_date) IN (5, 6) AS is_weekend,
         month(full_date) IN (3, 4) AS is_ramadan_season,
         month(full_date) = 9 AND day(full_date) BETWEEN 15 AND 25 AS is_national_day_season
  FROM dim_date_x
),
order_wide AS (
  SELECT f.order_id, CAST(strptime(CAST(f.date_id AS VARCHAR), '%Y%m%d') AS DATE) AS order_date,
         CAST(f.gross_amount - f.discount_amount AS DECIMAL(10,2)) AS order_amount_sar,
         f.vat_amount AS vat_amount_sar, f.payment_gateway AS payment_method,
         m.merchant_name, m.region_name_en AS merchant_region, m.subscription_plan AS subscription_tier,
         s.industry_category AS store_category
  FROM dw_fact_orders f JOIN dw_dim_store s ON f.store_id = s.store_id
  JOIN dw_dim_merchant m ON s.merchant_id = m.merchant_id
)
"""


def with_domain(body: str) -> str:
    """Prefix a query body with the adapter CTEs (merging a leading WITH)."""
    body = body.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + CTES.strip() + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + CTES.strip() + ",\n" + body[4:].lstrip()
    return "WITH " + CTES.strip() + "\n" + body
