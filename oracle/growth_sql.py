"""Oracle SQL for declared metrics, experiments and features."""

AS_OF = "DATE '2001-08-02'"
DAY = "CAST(strptime(CAST(date_id AS VARCHAR), '%Y%m%d') AS DATE)"


def ratio(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0)"


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def erfc(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {dbl(0.3275911)} * ({x})))"
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    poly = (f"{t} * ({dbl(a[0])} + {t} * ({dbl(a[1])} + {t} * ({dbl(a[2])} + {t} * ({dbl(a[3])}"
            f" + {t} * {dbl(a[4])}))))")
    return f"(({poly}) * exp(-(({x}) * ({x}))))"


def two_prop(x1, n1, x2, n2):
    p1 = f"(CAST({x1} AS DOUBLE) / {n1})"
    p2 = f"(CAST({x2} AS DOUBLE) / {n2})"
    pool = f"(CAST({x1} + {x2} AS DOUBLE) / ({n1} + {n2}))"
    se = f"sqrt({pool} * (1 - {pool}) * (1.0::DOUBLE / {n1} + 1.0::DOUBLE / {n2}))"
    z = f"(({p2} - {p1}) / NULLIF({se}, 0.0::DOUBLE))"
    se_u = f"sqrt({p1} * (1 - {p1}) / {n1} + {p2} * (1 - {p2}) / {n2})"
    diff = f"({p2} - {p1})"
    zc = dbl(1.959963984540054)
    return {
        "p_control": p1, "p_treatment": p2, "abs_uplift": diff,
        "rel_uplift": f"({diff} / NULLIF({p1}, 0.0::DOUBLE))", "z": z,
        "p_value": erfc(f"abs({z}) / {dbl(2.0 ** 0.5)}"),
        "ci_low": f"({diff} - {zc} * {se_u})", "ci_high": f"({diff} + {zc} * {se_u})",
    }


AB_BASE = """
ev AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant FROM events),
pu AS (SELECT variant, user_id, COUNT(*) AS n_events,
              COUNT(*) FILTER (WHERE event_type = 'view') AS views,
              COUNT(*) FILTER (WHERE event_type = 'click') AS clicks,
              COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases,
              SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(12,2)) END) AS revenue
       FROM ev GROUP BY variant, user_id),
pv AS (SELECT variant, COUNT(*) AS users, CAST(SUM(views) AS BIGINT) AS views, CAST(SUM(clicks) AS BIGINT) AS clicks,
              COUNT(*) FILTER (WHERE purchases > 0) AS buyers, CAST(SUM(purchases) AS BIGINT) AS purchases,
              CAST(COALESCE(SUM(revenue), 0) AS DECIMAL(20,2)) AS revenue,
              COUNT(*) FILTER (WHERE n_events = 1) AS bounced_users
       FROM pu GROUP BY variant),
rates AS (SELECT *, """ + ratio("clicks", "views") + " AS ctr, " + ratio("buyers", "users") + " AS cvr, " + \
    ratio("revenue", "purchases") + " AS aov, " + ratio("bounced_users", "users") + """ AS bounce_rate FROM pv),
wide AS (SELECT
   MAX(users) FILTER (WHERE variant = 'control') AS users_c, MAX(users) FILTER (WHERE variant = 'treatment') AS users_t,
   MAX(views) FILTER (WHERE variant = 'control') AS views_c, MAX(views) FILTER (WHERE variant = 'treatment') AS views_t,
   MAX(clicks) FILTER (WHERE variant = 'control') AS clicks_c, MAX(clicks) FILTER (WHERE variant = 'treatment') AS clicks_t,
   MAX(buyers) FILTER (WHERE variant = 'control') AS buyers_c, MAX(buyers) FILTER (WHERE variant = 'treatment') AS buyers_t,
   MAX(bounced_users) FILTER (WHERE variant = 'control') AS bounced_users_c,
   MAX(bounced_users) FILTER (WHERE variant = 'treatment') AS bounced_users_t,
   MAX(aov) FILTER (WHERE variant = 'control') AS aov_c, MAX(aov) FILTER (WHERE variant = 'treatment') AS aov_t
 FROM rates)
"""

_t = two_prop("buyers_c", "users_c", "buyers_t", "users_t")


def _chi():
    n = "(users_c + users_t)"
    ec, et = f"({n} * 0.5::DOUBLE)", f"({n} * 0.5::DOUBLE)"
    return f"(pow(users_c - {ec}, 2) / {ec} + pow(users_t - {et}, 2) / {et})"


BODIES = {
    "session_funnel": f"""
SELECT channel_source, device_type, sessions, carts, checkouts,
       {ratio('carts', 'sessions')} AS cart_rate, {ratio('checkouts', 'sessions')} AS checkout_rate,
       {ratio('checkouts', 'carts')} AS cart_to_checkout_rate
FROM (SELECT channel_source, device_type, COUNT(*) AS sessions, COUNT(*) FILTER (WHERE cart_added) AS carts,
             COUNT(*) FILTER (WHERE checkout_started) AS checkouts FROM d_sessions GROUP BY 1, 2) x""",
    "campaign_roi": f"""
WITH daily AS (SELECT store_id, {DAY} AS d, SUM(net_amount) AS net FROM dw_fact_orders GROUP BY 1, 2),
g AS (SELECT c.campaign_id, c.store_id, c.channel, c.ad_spend_sar,
             CAST(COALESCE(SUM(daily.net), 0) AS DECIMAL(20,2)) AS attributed_revenue
      FROM d_campaigns c LEFT JOIN daily ON c.store_id = daily.store_id AND daily.d BETWEEN c.start_date AND c.end_date
      GROUP BY 1, 2, 3, 4)
SELECT *, {ratio('attributed_revenue - ad_spend_sar', 'ad_spend_sar')} AS roi FROM g""",
    "customer_acquisition": f"""
SELECT CAST(date_trunc('month', d) AS DATE) AS cohort_month, COUNT(*) AS new_customers
FROM (SELECT customer_id, CAST(strptime(CAST(MIN(date_id) AS VARCHAR), '%Y%m%d') AS DATE) AS d
      FROM dw_fact_orders GROUP BY customer_id) x GROUP BY 1""",
    "gmv_growth": f"""
WITH ps AS (SELECT store_id, CAST(date_trunc('month', {DAY}) AS DATE) AS month, SUM(gross_amount) AS g
            FROM dw_fact_orders GROUP BY 1, 2),
mm AS (SELECT s.merchant_id, ps.month, CAST(SUM(ps.g) AS DECIMAL(20,2)) AS gmv
       FROM ps JOIN dw_dim_store s ON ps.store_id = s.store_id GROUP BY 1, 2),
l AS (SELECT *, LAG(gmv) OVER (PARTITION BY merchant_id ORDER BY month) AS prev_gmv FROM mm)
SELECT merchant_id, month, gmv, prev_gmv, {ratio('gmv - prev_gmv', 'prev_gmv')} AS growth FROM l""",
    "gmv_trajectory": f"""
WITH ps AS (SELECT store_id,
              SUM(CASE WHEN {DAY} >= {AS_OF} - 90 AND {DAY} < {AS_OF} THEN gross_amount END) AS r,
              SUM(CASE WHEN {DAY} >= {AS_OF} - 180 AND {DAY} < {AS_OF} - 90 THEN gross_amount END) AS p
            FROM dw_fact_orders GROUP BY store_id),
m AS (SELECT s.merchant_id, CAST(COALESCE(SUM(ps.r), 0) AS DECIMAL(20,2)) AS recent_gmv,
             CAST(COALESCE(SUM(ps.p), 0) AS DECIMAL(20,2)) AS prior_gmv
      FROM dw_dim_store s LEFT JOIN ps ON s.store_id = ps.store_id GROUP BY s.merchant_id)
SELECT *, {ratio('recent_gmv - prior_gmv', 'prior_gmv')} AS gmv_growth FROM m""",
    "repeat_purchase_rate": f"""
SELECT store_id, customers, repeat_customers, {ratio('repeat_customers', 'customers')} AS repeat_purchase_rate
FROM (SELECT store_id, COUNT(*) AS customers, COUNT(*) FILTER (WHERE n >= 2) AS repeat_customers
      FROM (SELECT store_id, customer_id, COUNT(DISTINCT order_id) AS n FROM dw_fact_orders GROUP BY 1, 2) a
      GROUP BY store_id) b""",
    "customer_order_count": """
SELECT c.customer_id, c.store_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS total_orders_count
FROM d_customers c LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM d_orders GROUP BY 1) n
  ON c.customer_id = n.customer_id""",
    "retention_cohort": f"""
WITH cm AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', {DAY}) AS DATE) AS month FROM dw_fact_orders),
c AS (SELECT *, MIN(month) OVER (PARTITION BY customer_id) AS cohort_month FROM cm)
SELECT cohort_month, CAST(datediff('month', cohort_month, month) AS INTEGER) AS months_since,
       COUNT(DISTINCT customer_id) AS active_customers FROM c GROUP BY 1, 2""",
    "product_ranking": """
WITH r AS (SELECT product_id, CAST(SUM(gross_sales) AS DECIMAL(20,2)) AS revenue FROM dw_fact_sales GROUP BY 1)
SELECT p.product_id, p.store_id, p.category_name_en, r.revenue,
       CAST(RANK() OVER (PARTITION BY p.store_id ORDER BY r.revenue DESC) AS INTEGER) AS store_rank,
       CAST(RANK() OVER (PARTITION BY p.store_id, p.category_name_en ORDER BY r.revenue DESC) AS INTEGER)
         AS category_rank
FROM dw_dim_product p JOIN r ON p.product_id = r.product_id""",
    "category_performance": f"""
SELECT category_name_en, units, revenue, gross_profit, {ratio('gross_profit', 'revenue')} * 100 AS margin_pct
FROM (SELECT p.category_name_en, CAST(SUM(s.quantity) AS BIGINT) AS units,
             CAST(SUM(s.gross_sales) AS DECIMAL(20,2)) AS revenue, CAST(SUM(s.gross_profit) AS DECIMAL(20,2)) AS gross_profit
      FROM dw_fact_sales s JOIN dw_dim_product p ON s.product_id = p.product_id GROUP BY 1) x""",
    "inventory_status": f"""
WITH u AS (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS units FROM dw_fact_sales
           WHERE {DAY} >= {AS_OF} - 30 AND {DAY} < {AS_OF} GROUP BY 1)
SELECT i.product_id, i.stock_quantity, i.reorder_level, i.stock_quantity <= i.reorder_level AS needs_reorder,
       CAST(COALESCE(u.units, 0) AS BIGINT) AS units_sold, {ratio('i.stock_quantity * 30', 'u.units')} AS days_of_cover
FROM d_inventory i LEFT JOIN u ON i.product_id = u.product_id""",
    "declining_products": f"""
SELECT *, {ratio('recent_revenue - prior_revenue', 'prior_revenue')} * 100 AS change_pct FROM (
  SELECT product_id,
         CAST(COALESCE(SUM(CASE WHEN {DAY} >= {AS_OF} - 180 THEN gross_sales END), 0) AS DECIMAL(20,2)) AS recent_revenue,
         CAST(COALESCE(SUM(CASE WHEN {DAY} < {AS_OF} - 180 THEN gross_sales END), 0) AS DECIMAL(20,2)) AS prior_revenue
  FROM dw_fact_sales WHERE {DAY} >= {AS_OF} - 360 AND {DAY} < {AS_OF} GROUP BY product_id) x
WHERE recent_revenue < prior_revenue""",
    "delivery_performance": f"""
SELECT courier_partner, shipments, delivered, {ratio('delivered', 'shipments')} * 100 AS delivered_pct,
       {ratio('d', 'n')} AS avg_delivery_days
FROM (SELECT courier_partner, COUNT(*) AS shipments, COUNT(*) FILTER (WHERE shipment_status = 'Delivered') AS delivered,
             SUM(datediff('day', shipped_at, delivered_at)) AS d, COUNT(datediff('day', shipped_at, delivered_at)) AS n
      FROM d_shipments GROUP BY 1) x""",
    "return_rate": f"""
SELECT store_id, orders, returned_orders, {ratio('returned_orders', 'orders')} AS return_rate
FROM (SELECT o.store_id, COUNT(*) AS orders, COUNT(r.order_id) AS returned_orders
      FROM d_orders o LEFT JOIN (SELECT DISTINCT order_id FROM d_returns) r ON o.order_id = r.order_id
      GROUP BY o.store_id) x""",
    "refund_by_reason": """
SELECT return_reason, COUNT(*) AS returns, CAST(SUM(refund_amount) AS DECIMAL(20,2)) AS refund_amount
FROM d_returns GROUP BY 1""",
    "review_rating_summary": f"""
SELECT product_id, reviews, {ratio('s', 'reviews')} AS avg_rating
FROM (SELECT product_id, SUM(rating_score) AS s, COUNT(rating_score) AS reviews FROM d_reviews GROUP BY 1) x""",
    "support_ticket_summary": """
SELECT merchant_id, category, priority, COUNT(*) AS tickets,
       COUNT(*) FILTER (WHERE ticket_status IN ('Open', 'In_Progress')) AS open_tickets
FROM d_tickets GROUP BY 1, 2, 3""",
    "coupon_usage": """
SELECT c.coupon_id, c.store_id, 'SAVE' || CAST(c.coupon_id AS VARCHAR) AS coupon_code,
       COUNT(o.d) AS uses, CAST(COALESCE(SUM(o.discount_amount), 0) AS DECIMAL(20,2)) AS discount_given
FROM d_coupons c LEFT JOIN (SELECT coupon_id, CAST(order_date AS DATE) AS d, discount_amount FROM d_orders
                            WHERE coupon_id IS NOT NULL) o
  ON c.coupon_id = o.coupon_id AND o.d BETWEEN c.start_date AND c.end_date
GROUP BY 1, 2, 3""",
    "seasonal_sales": """
SELECT d.is_weekend, d.is_ramadan_season, d.is_national_day_season, COUNT(*) AS orders,
       CAST(SUM(f.gross_amount) AS DECIMAL(20,2)) AS gmv
FROM dw_fact_orders f JOIN dim_date_t d ON f.date_id = d.date_id GROUP BY 1, 2, 3""",
    "customer_churn_risk": f"""
WITH g AS (SELECT customer_id, MIN({DAY}) AS first_order, MAX({DAY}) AS last_order, COUNT(*) AS orders
           FROM dw_fact_orders GROUP BY 1),
x AS (SELECT customer_id, orders, CAST(datediff('day', last_order, {AS_OF}) AS INTEGER) AS days_since_last,
             {ratio("datediff('day', first_order, last_order)", 'orders - 1')} AS mean_gap_days FROM g),
y AS (SELECT *, {ratio('days_since_last', 'mean_gap_days')} AS risk_ratio FROM x)
SELECT *, CASE WHEN orders <= 1 THEN 'One-time' WHEN risk_ratio > 2 THEN 'At Risk'
               WHEN risk_ratio > 1 THEN 'Cooling' ELSE 'Active' END AS risk_label FROM y""",
    "ab_rates": "WITH " + AB_BASE + " SELECT * FROM rates",
    "ab_two_proportion_test": "WITH " + AB_BASE + " SELECT users_c, users_t, buyers_c, buyers_t, "
        + ", ".join(f"ROUND({v}, 6) AS {k}" for k, v in _t.items()) + " FROM wide",
    "ab_srm_check": "WITH " + AB_BASE + f""" SELECT users_c, users_t, ROUND({_chi()}, 6) AS chi_square,
        ROUND({erfc(f'sqrt({_chi()} / 2.0::DOUBLE)')}, 6) AS p_value,
        {erfc(f'sqrt({_chi()} / 2.0::DOUBLE)')} >= 0.05 AS passed FROM wide""",
    "ab_ndcg_at_k": """
WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, user_id, event_id, ts,
                  CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS rel
           FROM events),
a AS (SELECT variant, user_id, rel, row_number() OVER (PARTITION BY variant, user_id ORDER BY ts, event_id) AS pos FROM e),
i AS (SELECT variant, user_id, rel, row_number() OVER (PARTITION BY variant, user_id ORDER BY rel DESC, event_id) AS pos
      FROM e),
ad AS (SELECT variant, user_id, SUM(CASE WHEN pos <= 5 THEN rel * (1.0::DOUBLE / log2(pos + 1)) END) AS dcg5,
              SUM(CASE WHEN pos <= 10 THEN rel * (1.0::DOUBLE / log2(pos + 1)) END) AS dcg10
       FROM a WHERE pos <= 10 GROUP BY 1, 2),
id AS (SELECT variant, user_id, SUM(CASE WHEN pos <= 5 THEN rel * (1.0::DOUBLE / log2(pos + 1)) END) AS idcg5,
              SUM(CASE WHEN pos <= 10 THEN rel * (1.0::DOUBLE / log2(pos + 1)) END) AS idcg10
       FROM i WHERE pos <= 10 GROUP BY 1, 2)
SELECT ad.variant, ROUND(AVG(dcg5 / NULLIF(idcg5, 0.0::DOUBLE)), 6) AS ndcg_at_5,
       ROUND(AVG(dcg10 / NULLIF(idcg10, 0.0::DOUBLE)), 6) AS ndcg_at_10
FROM ad JOIN id ON ad.variant = id.variant AND ad.user_id = id.user_id GROUP BY ad.variant""",
    "ab_cvr_daily": f"""
SELECT day, variant, users, buyers, {ratio('buyers', 'users')} AS cvr FROM (
  SELECT day, variant, COUNT(*) AS users, COUNT(*) FILTER (WHERE p > 0) AS buyers FROM (
    SELECT CAST(ts AS DATE) AS day, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, user_id,
           COUNT(*) FILTER (WHERE event_type = 'purchase') AS p
    FROM events GROUP BY 1, 2, 3) a GROUP BY 1, 2) b""",
    "feature_avg_aov_30d": f"""
WITH ps AS (SELECT store_id, date_id, SUM(net_amount) AS net, COUNT(*) AS orders FROM dw_fact_orders GROUP BY 1, 2),
md AS (SELECT s.merchant_id, ps.date_id, SUM(ps.net) AS net, SUM(ps.orders) AS orders
       FROM ps JOIN dw_dim_store s ON ps.store_id = s.store_id GROUP BY 1, 2),
w AS (SELECT merchant_id, {DAY} AS day,
             CAST(SUM(net) OVER win AS DECIMAL(20,2)) AS net_30d, CAST(SUM(orders) OVER win AS BIGINT) AS orders_30d
      FROM md WINDOW win AS (PARTITION BY merchant_id ORDER BY {DAY}
                             RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
SELECT *, {ratio('net_30d', 'orders_30d')} AS avg_aov_30d FROM w""",
    "feature_orders_7d": f"""
WITH ps AS (SELECT store_id, date_id, COUNT(*) AS orders FROM dw_fact_orders GROUP BY 1, 2),
md AS (SELECT s.merchant_id, ps.date_id, SUM(ps.orders) AS orders
       FROM ps JOIN dw_dim_store s ON ps.store_id = s.store_id GROUP BY 1, 2)
SELECT merchant_id, {DAY} AS day,
       CAST(SUM(orders) OVER (PARTITION BY merchant_id ORDER BY {DAY}
                              RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS orders_last_7d
FROM md""",
    "customer_preferred_gateway": """
SELECT customer_id, payment_gateway AS preferred_gateway, n AS orders_with_gateway,
       CAST(payment_gateway = 'Mada' AS INTEGER) AS mada_preferred_flag
FROM (SELECT customer_id, payment_gateway, n,
             row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, payment_gateway) AS r
      FROM (SELECT customer_id, payment_gateway, COUNT(*) AS n FROM dw_fact_orders GROUP BY 1, 2) a) b
WHERE r = 1""",
}

BODIES["churn_features"] = """
SELECT m.merchant_id, m.subscription_plan, m.status,
       CAST(COALESCE(SUM(f.gross_amount), 0) AS DECIMAL(20,2)) AS total_gmv,
       CAST(COALESCE(COUNT(DISTINCT f.order_id), 0) AS BIGINT) AS total_orders,
       COALESCE(CAST(SUM(f.net_amount) AS DOUBLE) / NULLIF(CAST(COUNT(f.net_amount) AS DOUBLE), 0), 0.0::DOUBLE)
         AS avg_order_value,
       CAST((SELECT COUNT(*) FROM d_tickets st WHERE st.merchant_id = m.merchant_id) AS BIGINT) AS support_ticket_count,
       CAST(m.status = 'Churned' AS INTEGER) AS is_churned
FROM dw_dim_merchant m
LEFT JOIN dw_dim_store s ON m.merchant_id = s.merchant_id
LEFT JOIN dw_fact_orders f ON s.store_id = f.store_id
GROUP BY m.merchant_id, m.subscription_plan, m.status"""

BODIES["clv_features"] = f"""
WITH rfm AS (
  SELECT c.customer_id, CAST(datediff('day', MAX(d.full_date), {AS_OF}) AS INTEGER) AS recency_days,
         COUNT(DISTINCT o.order_id) AS frequency_orders, CAST(SUM(o.net_amount) AS DECIMAL(20,2)) AS monetary_value
  FROM dw_dim_customer c JOIN dw_fact_orders o ON c.customer_id = o.customer_id
  JOIN dim_date_t d ON o.date_id = d.date_id GROUP BY c.customer_id)
SELECT customer_id, recency_days, frequency_orders, monetary_value,
       GREATEST(CAST(monetary_value AS DOUBLE) * 1.2::DOUBLE + CAST(frequency_orders AS DOUBLE) * 15.0::DOUBLE
                - CAST(recency_days AS DOUBLE) * 0.5::DOUBLE, 0.0::DOUBLE) AS future_12m_spend
FROM rfm"""

BODIES["merchant_health_by_merchant"] = """
SELECT s.merchant_id,
       CASE WHEN COALESCE(SUM(f.gross_sales), 1) > 0
            THEN ROUND(LEAST(100, GREATEST(0, LOG10(COALESCE(SUM(f.gross_sales), 1)) * 20
                                             + COUNT(DISTINCT f.order_id) * 0.1)), 6) END AS health_score
FROM dw_fact_sales f JOIN dw_dim_store s ON f.store_id = s.store_id GROUP BY s.merchant_id"""


def _quantile_sql(src: str, groups: list[str], col: str, qs: dict) -> str:
    """Exact interpolated quantiles with row_number (same arithmetic as the engine)."""
    g = ", ".join(groups)
    part = f"PARTITION BY {g} " if groups else ""
    sel_g = (g + ", ") if groups else ""
    lo_hi = ", ".join(
        f"MAX(CASE WHEN i = floor((n - 1) * {q!r}::DOUBLE) THEN v END) AS lo_{k}, "
        f"MAX(CASE WHEN i = ceil((n - 1) * {q!r}::DOUBLE) THEN v END) AS hi_{k}, "
        f"(n - 1) * {q!r}::DOUBLE - floor((n - 1) * {q!r}::DOUBLE) AS f_{k}" for k, q in qs.items())
    outs = ", ".join(f"lo_{k} + f_{k} * (hi_{k} - lo_{k}) AS {k}" for k in qs)
    return f"""(SELECT {sel_g}n, {outs} FROM (
      SELECT {sel_g}n, {lo_hi} FROM (
        SELECT {sel_g}CAST({col} AS DOUBLE) AS v,
               row_number() OVER ({part}ORDER BY CAST({col} AS DOUBLE)) - 1 AS i,
               COUNT(*) OVER ({"PARTITION BY " + g if groups else ""}) AS n
        FROM {src} WHERE {col} IS NOT NULL) r GROUP BY {sel_g}n) p)"""


_RFM = f"""(SELECT c.customer_id, CAST(datediff('day', MAX(d.full_date), {AS_OF}) AS INTEGER) AS recency_days,
         COUNT(DISTINCT o.order_id) AS frequency_orders, CAST(SUM(o.net_amount) AS DECIMAL(20,2)) AS monetary_value
  FROM dw_dim_customer c JOIN dw_fact_orders o ON c.customer_id = o.customer_id
  JOIN dim_date_t d ON o.date_id = d.date_id GROUP BY c.customer_id)"""
_Q5 = {"c1": 0.2, "c2": 0.4, "c3": 0.6, "c4": 0.8}


def _score(col, alias, reverse=False):
    above = " + ".join(f"CAST(CAST(rfm.{col} AS DOUBLE) > {alias}.c{i} AS INTEGER)" for i in range(1, 5))
    return f"(5 - ({above}))" if reverse else f"(({above}) + 1)"


BODIES["customer_segments"] = f"""
WITH rfm AS {_RFM},
rq AS {_quantile_sql('rfm', [], 'recency_days', _Q5)},
fq AS {_quantile_sql('rfm', [], 'frequency_orders', _Q5)},
mq AS {_quantile_sql('rfm', [], 'monetary_value', _Q5)},
s AS (SELECT rfm.*, {_score('recency_days', 'rq', True)} AS r, {_score('frequency_orders', 'fq')} AS f,
             {_score('monetary_value', 'mq')} AS m FROM rfm, rq, fq, mq)
SELECT customer_id, recency_days, frequency_orders, monetary_value, r AS r_score, f AS f_score, m AS m_score,
       CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions' WHEN f >= 4 THEN 'Loyal'
            WHEN m >= 4 THEN 'Big Spenders' WHEN r >= 4 AND f <= 2 THEN 'New'
            WHEN r <= 2 AND f >= 3 THEN 'At Risk' WHEN r <= 2 THEN 'Hibernating' ELSE 'Others' END AS segment
FROM s"""

BODIES["merchant_benchmark"] = f"""
WITH g AS (SELECT store_id, CAST(SUM(gross_amount) AS DECIMAL(20,2)) AS gmv FROM dw_fact_orders GROUP BY 1),
s AS (SELECT st.store_id, st.merchant_id, st.industry_category, g.gmv FROM dw_dim_store st JOIN g ON st.store_id = g.store_id),
med AS {_quantile_sql('s', ['industry_category'], 'gmv', {'industry_median_gmv': 0.5})}
SELECT s.store_id, s.merchant_id, s.industry_category, s.gmv, med.industry_median_gmv,
       {ratio('s.gmv', 'med.industry_median_gmv')} AS vs_median
FROM s JOIN med ON s.industry_category = med.industry_category"""


def _split(src: str, id_col: str, label: str | None) -> str:
    part = f"PARTITION BY {label} " if label else ""
    h = f"CAST((({id_col} % 4294967296) * 2654435761::HUGEINT + 42) % 4294967296 AS BIGINT)"
    sel = f"{label}, " if label else ""
    return f"""
SELECT {sel}is_test, COUNT(*) AS rows FROM (
  SELECT {sel}row_number() OVER ({part}ORDER BY {h}) - 1
           < ROUND(CAST(COUNT(*) OVER ({part.strip()}) AS DOUBLE) * 0.2) AS is_test
  FROM {src}) x GROUP BY ALL"""


BODIES["stratified_split"] = "WITH cf AS (" + BODIES["churn_features"] + ")" + _split("cf", "merchant_id", "is_churned")
BODIES["stratified_split_customers"] = "WITH cf AS (" + BODIES["clv_features"].strip() + ")" + _split(
    "cf", "customer_id", None)
