"""Oracle SQL for point-in-time features (DuckDB's ASOF JOIN) and inventory movement (plain windows)."""

from .growth_sql import DAY, ratio

_FEATURES = f"""
WITH o AS (SELECT f.order_id, s.merchant_id, {DAY} AS day, f.net_amount FROM dw_fact_orders f JOIN dw_dim_store s USING (store_id)),
daily AS (SELECT merchant_id, day, sum(net_amount) AS net, count(*) AS n FROM o GROUP BY ALL),
feat AS (
  SELECT merchant_id, (day + 1)::DATE AS known_from, (sum(net) OVER m)::DECIMAL(20,2) AS net_30d, (sum(n) OVER m)::BIGINT AS orders_30d,
         (sum(n) OVER w)::BIGINT AS orders_last_7d
  FROM daily
  WINDOW m AS (PARTITION BY merchant_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW),
         w AS (PARTITION BY merchant_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)),
hit AS (
  SELECT o.order_id, o.merchant_id, o.day AS order_day, feat.known_from AS feature_time, net_30d, orders_30d, orders_last_7d
  FROM o ASOF LEFT JOIN feat ON o.merchant_id = feat.merchant_id AND o.day >= feat.known_from)"""


def _looked_up(keep: str) -> str:
    def col(c):
        return f"CASE WHEN {keep} THEN {c} END AS {c}"
    return (f"{_FEATURES} SELECT order_id, merchant_id, order_day, {', '.join(map(col, ('net_30d', 'orders_30d', 'orders_last_7d', 'feature_time')))}, "
            f"CASE WHEN {keep} THEN {ratio('net_30d', 'orders_30d')} END AS avg_aov_30d FROM hit")


_MOVES = f"""
WITH bought AS (SELECT order_id, product_id, sum(quantity) AS units, sum(gross_sales) AS paid FROM dw_fact_sales GROUP BY ALL),
moves AS (
  SELECT product_id, {DAY} AS moved_on, 'sale' AS kind, order_item_id AS ref_id, -quantity::BIGINT AS change FROM dw_fact_sales
  UNION ALL
  SELECT product_id, requested_at::DATE, 'return', return_id,
         coalesce(((2 * (refund_amount * 100)::HUGEINT * units + (paid * 100)::HUGEINT) // nullif(2 * (paid * 100)::HUGEINT, 0))::BIGINT, 0)
  FROM d_returns JOIN bought USING (order_id, product_id) WHERE return_status IN ('Approved', 'Refunded')),
ledger AS (
  SELECT m.product_id, moved_on, kind, ref_id, change, i.reorder_level,
         (i.stock_quantity - sum(change) OVER (PARTITION BY m.product_id)
            + sum(change) OVER (PARTITION BY m.product_id ORDER BY moved_on, kind, ref_id ROWS UNBOUNDED PRECEDING))::BIGINT AS balance_after
  FROM moves m JOIN d_inventory i ON i.product_id = m.product_id)"""

BODIES = {
    "features_at_order": _looked_up("true"),
    "features_at_order_fresh": _looked_up("feature_time >= order_day - 3"),
    "inventory_ledger": f"{_MOVES} SELECT product_id, moved_on, kind, ref_id, change, balance_after FROM ledger",
    "inventory_movement": f"""{_MOVES},
per AS (SELECT product_id, sum(-change) FILTER (kind = 'sale') AS sold, sum(change) FILTER (kind = 'return') AS returned,
               min(balance_after) AS lowest, min(moved_on) FILTER (balance_after <= reorder_level) AS first_at_reorder,
               count(*) FILTER (balance_after < 0) AS below FROM ledger GROUP BY product_id),
low AS (SELECT l.product_id, min(l.moved_on) AS lowest_on FROM ledger l JOIN per USING (product_id)
        WHERE l.balance_after = per.lowest GROUP BY l.product_id)
SELECT i.product_id, (i.stock_quantity + coalesce(sold, 0) - coalesce(returned, 0))::BIGINT AS opening, coalesce(sold, 0)::BIGINT AS sold,
       coalesce(returned, 0)::BIGINT AS returned, i.stock_quantity::BIGINT AS closing, coalesce(lowest, i.stock_quantity)::BIGINT AS lowest,
       lowest_on, first_at_reorder, coalesce(below, 0) AS movements_below_zero
FROM d_inventory i LEFT JOIN per USING (product_id) LEFT JOIN low USING (product_id)""",
}
