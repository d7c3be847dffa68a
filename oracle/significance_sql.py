"""Oracle SQL for the significance of experiment metrics.

Written from the definitions: per-user values with their sample variances
(``var_samp`` of the linearised values), Student's t through the continued
fraction of the incomplete beta function, and for the sequential tests every
day's totals from all users anew.
"""

from .growth_sql import dbl, erfc

Z = dbl(1.959963984540054)

USERS = """
ev AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant FROM events),
rel AS (SELECT *, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS rel FROM ev),
ranks AS (SELECT variant, user_id, rel, row_number() OVER (PARTITION BY variant, user_id ORDER BY ts, event_id) AS a,
                 row_number() OVER (PARTITION BY variant, user_id ORDER BY rel DESC, event_id) AS b FROM rel),
ndcg AS (SELECT variant, user_id,
   sum(rel / log2(a + 1.0::DOUBLE)) FILTER (a <= 5) / nullif(sum(rel / log2(b + 1.0::DOUBLE)) FILTER (b <= 5), 0) AS n5,
   sum(rel / log2(a + 1.0::DOUBLE)) FILTER (a <= 10) / nullif(sum(rel / log2(b + 1.0::DOUBLE)) FILTER (b <= 10), 0) AS n10
   FROM ranks GROUP BY ALL),
u AS (SELECT variant, user_id, count(*) AS events, count(*) FILTER (event_type = 'view')::DOUBLE AS views,
             count(*) FILTER (event_type = 'click')::DOUBLE AS clicks, count(*) FILTER (event_type = 'purchase')::DOUBLE AS purchases,
             coalesce(sum(value::DECIMAL(12,2)) FILTER (event_type = 'purchase'), 0)::DOUBLE AS revenue
      FROM ev GROUP BY ALL),
obs AS (
  SELECT 'CTR' AS metric, variant, user_id, clicks AS y, views AS x FROM u
  UNION ALL SELECT 'AOV', variant, user_id, revenue, purchases FROM u
  UNION ALL SELECT 'NDCG@5', variant, user_id, n5, 1 FROM ndcg WHERE n5 IS NOT NULL
  UNION ALL SELECT 'NDCG@10', variant, user_id, n10, 1 FROM ndcg WHERE n10 IS NOT NULL),
r AS (SELECT metric, variant, sum(y) / nullif(sum(x), 0) AS ratio, avg(x) AS mx FROM obs GROUP BY ALL),
s AS (SELECT metric, variant, any_value(ratio) AS ratio, count(*) AS n, var_samp((y - ratio * x) / mx) / count(*) AS v
      FROM obs JOIN r USING (metric, variant) GROUP BY ALL),
w AS (SELECT c.metric, c.ratio AS control, t.ratio AS treatment, sqrt(c.v + t.v) AS se,
             (t.ratio - c.ratio) / nullif(sqrt(c.v + t.v), 0) AS stat,
             (c.v + t.v) ** 2 / (c.v ** 2 / (c.n - 1) + t.v ** 2 / (t.n - 1)) AS dof
      FROM s c JOIN s t ON c.metric = t.metric AND c.variant = 'control' AND t.variant = 'treatment'),
"""

# p = I_x(a, b) with a = dof / 2, b = 1/2, x = dof / (dof + t^2); the continued fraction converges fast for
# x < (a + 1) / (a + b + 2), else 1 - I_{1 - x}(b, a) is used
BETA = """
args AS (SELECT metric, dof / 2 AS a0, 0.5::DOUBLE AS b0, dof / (dof + stat * stat) AS x0 FROM w),
arg AS (SELECT metric, x0 >= (a0 + 1) / (a0 + b0 + 2) AS flip,
               CASE WHEN x0 >= (a0 + 1) / (a0 + b0 + 2) THEN b0 ELSE a0 END AS a,
               CASE WHEN x0 >= (a0 + 1) / (a0 + b0 + 2) THEN a0 ELSE b0 END AS b,
               CASE WHEN x0 >= (a0 + 1) / (a0 + b0 + 2) THEN 1 - x0 ELSE x0 END AS x FROM args),
cf AS (
  SELECT metric, flip, a, b, x, 0 AS m, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h
  FROM arg
  UNION ALL
  SELECT metric, flip, a, b, x, m, c2, d2, h1 * d2 * c2 FROM (
    SELECT *, 1 / (1 + odd * d1) AS d2, 1 + odd / c1 AS c2 FROM (
      SELECT *, h * d1 * c1 AS h1, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) AS odd FROM (
        SELECT metric, flip, a, b, x, m, h, 1 / (1 + even * d) AS d1, 1 + even / c AS c1 FROM (
          SELECT metric, flip, a, b, x, m + 1 AS m, c, d, h,
                 (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS even
          FROM cf WHERE m < 300))))),
pt AS (SELECT metric, CASE WHEN flip THEN 1 - i ELSE i END AS p FROM (
         SELECT metric, flip, exp(a * ln(x) + b * ln(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) * h / a AS i
         FROM cf WHERE m = 300)),
"""

PROPORTIONS = f"""
share AS (SELECT metric, sum(hit) FILTER (variant = 'control') AS xc, count(*) FILTER (variant = 'control') AS nc,
                 sum(hit) FILTER (variant = 'treatment') AS xt, count(*) FILTER (variant = 'treatment') AS nt
          FROM (SELECT 'CVR' AS metric, variant, (purchases > 0)::INT::DOUBLE AS hit FROM u
                UNION ALL SELECT 'Bounce Rate', variant, (events = 1)::INT FROM u) GROUP BY metric),
z AS (SELECT metric, xc / nc AS control, xt / nt AS treatment,
             sqrt(xc / nc * (1 - xc / nc) / nc + xt / nt * (1 - xt / nt) / nt) AS se,
             (xt / nt - xc / nc) / nullif(sqrt((xc + xt) / (nc + nt) * (1 - (xc + xt) / (nc + nt)) * (1.0::DOUBLE / nc + 1.0::DOUBLE / nt)), 0) AS stat
      FROM share),
q AS (SELECT {Z} AS q),
tests AS (
  SELECT metric, CASE WHEN metric IN ('CTR', 'AOV') THEN 'delta' ELSE 'welch' END AS method, control, treatment, se, stat, dof, p,
         q + (q ** 3 + q) / 4 / dof + (5 * q ** 5 + 16 * q ** 3 + 3 * q) / 96 / dof ** 2
           + (3 * q ** 7 + 19 * q ** 5 + 17 * q ** 3 - 15 * q) / 384 / dof ** 3
           + (79 * q ** 9 + 776 * q ** 7 + 1482 * q ** 5 - 1920 * q ** 3 - 945 * q) / 92160 / dof ** 4 AS quantile
  FROM w JOIN pt USING (metric), q
  UNION ALL
  SELECT metric, 'two-proportion', control, treatment, se, stat, NULL, {erfc(f"abs(stat) / {dbl(2.0 ** 0.5)}")}, q FROM z, q)
"""

LEDGER = "WITH RECURSIVE " + USERS + BETA + PROPORTIONS


def _sequential(user_day: str, totals: str, columns: str, tau: float, rate: str, spread: str) -> str:
    """Every day's totals from all users up to that day, then the running minimum of 1 / likelihood ratio."""
    t2 = dbl(tau * tau)
    return f"""
WITH ev AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant, ts::DATE AS day FROM events),
days AS (SELECT unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM ev),
state AS ({user_day}),
tot AS (SELECT day, {totals} FROM state GROUP BY day),
est AS (SELECT *, {rate.format(s='t')} - {rate.format(s='c')} AS diff, nullif({spread.format(s='c')} + {spread.format(s='t')}, 0) AS v FROM tot),
lr AS (SELECT *, 0.5 * ln(v / (v + {t2})) + {t2} * diff * diff / (2 * v * (v + {t2})) AS l,
              sqrt(v * (v + {t2}) / {t2} * (ln((v + {t2}) / v) - 2 * ln(0.05::DOUBLE))) AS half FROM est),
pv AS (SELECT *, least(1, exp(-max(coalesce(l, 0)) OVER (ORDER BY day))) AS p FROM lr)
SELECT day, {columns}, round(diff, 6) AS abs_uplift, round(l, 6) AS log_likelihood_ratio, round(diff - half, 6) AS ci_low,
       round(diff + half, 6) AS ci_high, round(p, 6) AS p_value, p <= 0.05 AS significant FROM pv"""


BODIES = {
    "ab_significance": LEDGER + """
SELECT metric, method, round(control, 6) AS control, round(treatment, 6) AS treatment, round(treatment - control, 6) AS abs_uplift,
       round((treatment - control) / nullif(control, 0), 6) AS rel_uplift, round(se, 6) AS std_error, round(stat, 6) AS statistic,
       round(dof, 6) AS dof, round(p, 6) AS p_value, round(treatment - control - se * quantile, 6) AS ci_low,
       round(treatment - control + se * quantile, 6) AS ci_high FROM tests""",
    "ab_metric_table": LEDGER + """
SELECT metric, round(control, 6) AS control, round(treatment, 6) AS treatment, round(treatment - control, 6) AS abs_uplift,
       round((treatment - control) / nullif(control, 0), 6) AS rel_uplift, round(p, 6) AS p_value FROM tests""",
    "ab_sequential_cvr": _sequential(
        """SELECT d.day, variant, user_id, max((event_type = 'purchase')::INT) AS bought
           FROM days d JOIN ev ON ev.day <= d.day GROUP BY ALL""",
        ", ".join(f"count(*) FILTER (variant = '{v}') AS users_{s}, coalesce(sum(bought) FILTER (variant = '{v}'), 0)::BIGINT AS buyers_{s}"
                  for v, s in (("control", "c"), ("treatment", "t"))),
        "users_c, users_t, buyers_c, buyers_t, round(buyers_c::DOUBLE / nullif(users_c, 0), 6) AS cvr_c, round(buyers_t::DOUBLE / nullif(users_t, 0), 6) AS cvr_t",
        0.05, "buyers_{s}::DOUBLE / nullif(users_{s}, 0)",
        "(buyers_{s}::DOUBLE / nullif(users_{s}, 0)) * (1 - buyers_{s}::DOUBLE / nullif(users_{s}, 0)) / nullif(users_{s}, 0)"),
    "ab_sequential_revenue": _sequential(
        """SELECT d.day, variant, user_id, coalesce(sum(value::DECIMAL(12,2)) FILTER (event_type = 'purchase'), 0) AS r
           FROM days d JOIN ev ON ev.day <= d.day GROUP BY ALL""",
        ", ".join(f"count(*) FILTER (variant = '{v}') AS users_{s}, coalesce(sum(r) FILTER (variant = '{v}'), 0)::DECIMAL(28,2) AS revenue_{s}, "
                  f"var_samp(r::DOUBLE) FILTER (variant = '{v}') / count(*) FILTER (variant = '{v}') AS v_{s}"
                  for v, s in (("control", "c"), ("treatment", "t"))),
        "users_c, users_t, revenue_c, revenue_t, round(revenue_c::DOUBLE / nullif(users_c, 0), 6) AS arpu_c, round(revenue_t::DOUBLE / nullif(users_t, 0), 6) AS arpu_t",
        50.0, "revenue_{s}::DOUBLE / nullif(users_{s}, 0)", "v_{s}"),
}
