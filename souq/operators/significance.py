"""Significance of experiment metrics whose unit is the user.

Users are assigned to variants, so users are independent and their events are
not: many clicks of one user are one observation.  Every metric is therefore
reduced to one row per user, then to sufficient statistics per variant
(count, sums, sums of squares, cross products), all combined map-side; what
remains is column arithmetic on one row per variant.

* proportions of users (CVR, bounce rate): pooled two-proportion z-test
* means over users (NDCG): Welch's test
* ratios of sums (CTR = clicks / views, AOV = revenue / purchases): the delta
  method, i.e. Welch's test on the linearised values (y - R x) / mean(x)
* sequential tests: cumulative statistics per day and an always-valid p-value
  from a normal mixture likelihood ratio, so looking every day does not raise
  the share of false alarms
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import r6, student_two_sided_p
from .experiments import CONTROL, TREATMENT, Z_95, _per_user, assign_variant, two_proportion, user_ndcg

MONEY = "decimal(18,2)"


# ---- sufficient statistics ---------------------------------------------------------------
def moments(users: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per variant: for each named (numerator y, denominator x) of the per-user rows the
    users ``n``, sums ``y``, ``x`` and sums of products ``yy``, ``xx``, ``xy``, as ``name_n`` etc.

    Users with a null numerator or denominator do not count.
    """
    aggs = []
    for name, (y, x) in pairs.items():
        both = y.isNotNull() & x.isNotNull()
        for key, value in (("y", y), ("x", x), ("yy", y * y), ("xx", x * x), ("xy", x * y)):
            aggs.append(F.sum(F.when(both, value)).cast("double").alias(f"{name}_{key}"))
        aggs.append(F.count_if(both).alias(f"{name}_n"))
    return users.groupBy("variant").agg(*aggs)


def linearised(name: str) -> tuple[Column, Column, Column]:
    """Ratio y / x, variance of the ratio and number of users from the moments of ``name``.

    With a constant denominator of 1 the ratio is the mean and the variance that of the mean.
    """
    y, x, yy, xx, xy, n = (F.col(f"{name}_{k}") for k in ("y", "x", "yy", "xx", "xy", "n"))
    x = F.nullif(x, F.lit(0.0))
    ratio = y / x
    squares = F.greatest(F.lit(0.0), yy - 2.0 * ratio * xy + ratio * ratio * xx)
    # sum of squared linearised values / (n - 1) / n, with mean(x) = x / n
    return ratio, squares / F.nullif(n - 1, F.lit(0)) * n / (x * x), n


def welch(name: str) -> dict[str, Column]:
    """Welch's unequal-variance test of treatment against control from one row with name_ratio_c, name_ratio_t, name_var_c, ... ."""
    c, t, vc, vt = (F.col(f"{name}_{k}") for k in ("ratio_c", "ratio_t", "var_c", "var_t"))
    nc, nt = F.col(f"{name}_n_c"), F.col(f"{name}_n_t")
    se = F.sqrt(vc + vt)
    dof = (vc + vt) ** 2 / F.nullif(vc ** 2 / (nc - 1) + vt ** 2 / (nt - 1), F.lit(0.0))
    stat = (t - c) / F.nullif(se, F.lit(0.0))
    return {"control": c, "treatment": t, "std_error": se, "statistic": stat, "dof": dof,
            "p_value": student_two_sided_p(stat, dof)}


def _proportion(x: str, n: str) -> dict[str, Column]:
    z = two_proportion(F.col(f"{x}_c"), F.col(f"{n}_c"), F.col(f"{x}_t"), F.col(f"{n}_t"))
    return {"control": z["p_control"], "treatment": z["p_treatment"],
            "std_error": (z["ci_high"] - z["ci_low"]) / (2 * Z_95), "statistic": z["z"],
            "dof": F.lit(None).cast("double"), "p_value": z["p_value"]}


# ---- X6: the ledger -------------------------------------------------------------------------
# Names and order of the ledger's rows.
LEDGER = ("CTR", "CVR", "NDCG@5", "NDCG@10", "AOV", "Bounce Rate")
METHOD = {"CTR": "delta", "CVR": "two-proportion", "NDCG@5": "welch", "NDCG@10": "welch", "AOV": "delta",
          "Bounce Rate": "two-proportion"}


def ab_significance(events: DataFrame) -> DataFrame:
    """The six metrics of the ledger with control, treatment, uplifts, standard error of the
    uplift, statistic, degrees of freedom (null for a z-test), p-value and 95 % interval.

    A metric that a variant cannot give (no users, no views, no purchases, a
    single user) has nulls; equal values without any variance have no
    statistic and no p-value.
    """
    one = F.lit(1.0)
    per_user = _per_user(events)
    ndcg = user_ndcg(events, (5, 10)).select("variant", "user_id", "ndcg_at_5", "ndcg_at_10")
    users = per_user.join(ndcg, ["variant", "user_id"], "left")
    purchases = F.col("purchases").cast("decimal(18,0)")
    rows = users.withColumn("revenue", F.coalesce("revenue", F.lit(0)).cast(MONEY))
    m = moments(rows, {
        "ctr": (F.col("clicks").cast("decimal(18,0)"), F.col("views").cast("decimal(18,0)")),
        "aov": (F.col("revenue"), purchases),
        "ndcg5": (F.col("ndcg_at_5"), one), "ndcg10": (F.col("ndcg_at_10"), one),
        "buyer": (F.when(F.col("purchases") > 0, 1).otherwise(0), F.lit(1)),
        "bounce": (F.when(F.col("n_events") == 1, 1).otherwise(0), F.lit(1))})
    shares = [F.max(F.when(F.col("variant") == v, F.col(f"{k}_{p}"))).alias(f"{k}_{q}_{s}")
              for k in ("buyer", "bounce") for p, q in (("y", "hits"), ("n", "users"))
              for v, s in ((CONTROL, "c"), (TREATMENT, "t"))]
    # both one-row frames come from the same two rows, in one aggregate
    means = ["ctr", "aov", "ndcg5", "ndcg10"]
    linear = m.select("variant", *[f"{k}_{p}" for k in ("buyer", "bounce") for p in ("y", "n")],
                      *[c.alias(f"{k}_{p}") for k in means for p, c in zip(("ratio", "var", "n"), linearised(k))])
    wide = linear.agg(*shares, *[F.max(F.when(F.col("variant") == v, F.col(f"{k}_{p}"))).alias(f"{k}_{p}_{s}")
                                 for k in means for p in ("ratio", "var", "n") for v, s in ((CONTROL, "c"), (TREATMENT, "t"))])
    tests = {"CTR": welch("ctr"), "CVR": _proportion("buyer_hits", "buyer_users"), "NDCG@5": welch("ndcg5"),
             "NDCG@10": welch("ndcg10"), "AOV": welch("aov"), "Bounce Rate": _proportion("bounce_hits", "bounce_users")}

    def row(metric):
        t = tests[metric]
        diff = t["treatment"] - t["control"]
        # half width: the normal quantile for z-tests; for Student's t its expansion in 1 / dof
        half = t["std_error"] * F.coalesce(student_quantile_975(t["dof"]), F.lit(Z_95))
        return F.struct(F.lit(metric).alias("metric"), F.lit(METHOD[metric]).alias("method"),
                        *[r6(c).alias(k) for k, c in (
                            ("control", t["control"]), ("treatment", t["treatment"]), ("abs_uplift", diff),
                            ("rel_uplift", diff / F.nullif(t["control"], F.lit(0.0))), ("std_error", t["std_error"]),
                            ("statistic", t["statistic"]), ("dof", t["dof"]), ("p_value", t["p_value"]),
                            ("ci_low", diff - half), ("ci_high", diff + half))])
    return wide.select(F.inline(F.array(*[row(m) for m in LEDGER])))


def student_quantile_975(dof: Column) -> Column:
    """The 97.5 % quantile of Student's t by its expansion around the normal quantile
    (within 1e-4 from 10 degrees of freedom on)."""
    z = Z_95
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    return z + g1 / dof + g2 / dof ** 2 + g3 / dof ** 3 + g4 / dof ** 4


# ---- X2, X5: sequential tests ------------------------------------------------------------------
def always_valid(daily: DataFrame, diff: Column, variance: Column, tau: float, alpha: float) -> DataFrame:
    """Add the running always-valid p-value to one row per day.

    The mixture likelihood ratio of a difference estimate with variance V
    against 0, mixed over a normal prior of standard deviation ``tau``, is
    sqrt(V / (V + tau^2)) exp(tau^2 diff^2 / (2 V (V + tau^2))).  The p-value
    is the smallest 1 / ratio so far, so it never rises and may be read on any
    day.  The interval is the confidence sequence of the same mixture.  Days
    on which a variant has no users yet, or the variance is 0, add no evidence.
    """
    t2 = tau * tau
    v = F.nullif(variance, F.lit(0.0))
    log_ratio = 0.5 * F.log(v / (v + t2)) + t2 * diff * diff / (2.0 * v * (v + t2))
    half = F.sqrt(v * (v + t2) / t2 * (F.log((v + t2) / v) - 2.0 * math.log(alpha)))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a day
    out = daily.withColumn("diff", diff).withColumn("log_ratio", log_ratio) \
        .withColumn("low", diff - half).withColumn("high", diff + half) \
        .withColumn("p", F.min(F.least(F.lit(1.0), F.exp(-F.coalesce("log_ratio", F.lit(0.0))))).over(so_far))
    return out.withColumn("significant", F.col("p") <= alpha)


def _days(events: DataFrame) -> DataFrame:
    """Every day from the first event to the last, also those without events."""
    bounds = events.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi")).where("lo is not null")
    return bounds.select(F.explode(F.sequence("lo", "hi")).alias("day"))


def _cumulative(events: DataFrame, increments: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running totals per day and variant, one row per day with _c and _t columns.

    ``increments`` has day, variant and the columns of ``sums`` (name -> type); one row per day and variant at most.
    """
    wide = increments.groupBy("day").agg(*[
        F.sum(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{s}") for c in sums for v, s in ((CONTROL, "c"), (TREATMENT, "t"))])
    dense = _days(events).join(wide, "day", "left")
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a day
    return dense.select("day", *[F.coalesce(F.sum(f"{c}_{s}").over(so_far), F.lit(0)).cast(kind).alias(f"{c}_{s}")
                                 for c, kind in sums.items() for s in ("c", "t")])


def ab_sequential_cvr(events: DataFrame, tau: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """Per day the users and buyers so far, their rates, and the always-valid p-value.

    A user counts from the day of the first event, a buyer from the day of
    the first purchase: both are minima per user, so the running totals are
    sums of daily increments and no distinct count is rolled up.
    """
    day = F.to_date("ts")
    first = assign_variant(events).groupBy("variant", "user_id").agg(
        F.min(day).alias("seen"), F.min(F.when(F.col("event_type") == "purchase", day)).alias("bought"))
    steps = first.select("variant", F.explode(F.array(
        F.struct(F.col("seen").alias("day"), F.lit(1).alias("users"), F.lit(0).alias("buyers")),
        F.struct(F.col("bought").alias("day"), F.lit(0).alias("users"), F.lit(1).alias("buyers")))).alias("s")) \
        .select("variant", "s.*").where("day is not null") \
        .groupBy("day", "variant").agg(F.sum("users").alias("users"), F.sum("buyers").alias("buyers"))
    d = _cumulative(events, steps, {"users": "long", "buyers": "long"})

    def rate(s):
        return F.col(f"buyers_{s}").cast("double") / F.nullif(F.col(f"users_{s}"), F.lit(0))

    def spread(s):
        return rate(s) * (1.0 - rate(s)) / F.nullif(F.col(f"users_{s}"), F.lit(0))
    out = always_valid(d, rate("t") - rate("c"), spread("c") + spread("t"), tau, alpha)
    return out.select("day", "users_c", "users_t", "buyers_c", "buyers_t", r6(rate("c")).alias("cvr_c"),
                      r6(rate("t")).alias("cvr_t"), r6(F.col("diff")).alias("abs_uplift"), r6(F.col("log_ratio")).alias("log_likelihood_ratio"),
                      r6(F.col("low")).alias("ci_low"), r6(F.col("high")).alias("ci_high"),
                      r6(F.col("p")).alias("p_value"), "significant")


def ab_sequential_revenue(events: DataFrame, tau: float = 50.0, alpha: float = 0.05) -> DataFrame:
    """The same for revenue per user.

    A user's revenue grows over days, and with it the sum of squares by
    (r + x)^2 - r^2: the running revenue of each user is a window over that
    user's days, after the events of a day are summed.  Sums are exact decimals.
    """
    day = F.to_date("ts")
    paid = F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(12,2)")).otherwise(F.lit(0))
    by_day = assign_variant(events).where(F.col("ts").isNotNull()).groupBy("variant", "user_id", day.alias("day")) \
        .agg(F.coalesce(F.sum(paid), F.lit(0)).cast(MONEY).alias("x"))
    own = Window.partitionBy("variant", "user_id").orderBy("day")
    before = F.coalesce(F.sum("x").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(MONEY)
    steps = by_day.select("variant", "day", "x", before.alias("r"), (F.row_number().over(own) == 1).cast("int").alias("users")) \
        .groupBy("day", "variant").agg(
            F.sum("users").alias("users"), F.sum("x").alias("total"),
            F.sum(F.col("x") * F.col("x") + F.lit(2) * F.col("x") * F.col("r")).alias("squares"))
    d = _cumulative(events, steps, {"users": "long", "total": "decimal(28,2)", "squares": "decimal(38,4)"})

    def mean(s):
        return F.col(f"total_{s}").cast("double") / F.nullif(F.col(f"users_{s}"), F.lit(0))

    def spread(s):
        n = F.col(f"users_{s}")
        centred = F.greatest(F.lit(0.0), F.col(f"squares_{s}").cast("double") - mean(s) * F.col(f"total_{s}").cast("double"))
        return centred / F.nullif(n - 1, F.lit(0)) / F.nullif(n, F.lit(0))
    out = always_valid(d, mean("t") - mean("c"), spread("c") + spread("t"), tau, alpha)
    return out.select("day", "users_c", "users_t", F.col("total_c").alias("revenue_c"), F.col("total_t").alias("revenue_t"),
                      r6(mean("c")).alias("arpu_c"), r6(mean("t")).alias("arpu_t"), r6(F.col("diff")).alias("abs_uplift"),
                      r6(F.col("log_ratio")).alias("log_likelihood_ratio"), r6(F.col("low")).alias("ci_low"),
                      r6(F.col("high")).alias("ci_high"), r6(F.col("p")).alias("p_value"), "significant")
