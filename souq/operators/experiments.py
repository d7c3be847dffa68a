"""A/B experiment statistics (X1-X5) over the event stream; significance.py has the ledger.

The reference shows these as constants; the definitions here are ours:
variant = user_id % 2 (0 control, 1 treatment); a "view", "click" or
"purchase" event is an impression, click or conversion; a bounced user has
exactly one event.  Every statistic is a two-level aggregate (per user,
then per variant) -- partial aggregation makes a hot user cost one row --
followed by column arithmetic on the two-row result.  Purchase values are
summed as exact decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import safe_ratio
from ..functions.stats import chi2_1dof_p, normal_two_sided_p, r6

CONTROL, TREATMENT = "control", "treatment"
# relevance grades of an event for ranking quality
RELEVANCE = {"purchase": 3, "click": 2, "view": 1}
Z_95 = 1.959963984540054


def assign_variant(events: DataFrame) -> DataFrame:
    return events.withColumn("variant", F.when(F.col("user_id") % 2 == 0, CONTROL).otherwise(TREATMENT))


def _per_user(events: DataFrame) -> DataFrame:
    e = assign_variant(events)
    et = F.col("event_type")
    return e.groupBy("variant", "user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(et == "view").alias("views"),
        F.count_if(et == "click").alias("clicks"),
        F.count_if(et == "purchase").alias("purchases"),
        F.sum(F.when(et == "purchase", F.col("value").cast("decimal(12,2)"))).alias("revenue"),
    )


def ab_rates(events: DataFrame) -> DataFrame:
    """Per variant users, CTR = clicks/views, CVR = buyers/users, AOV, bounce rate."""
    v = _per_user(events).groupBy("variant").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("views").cast("long").alias("views"),
        F.sum("clicks").cast("long").alias("clicks"),
        F.count_if(F.col("purchases") > 0).alias("buyers"),
        F.sum("purchases").cast("long").alias("purchases"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(20,2)").alias("revenue"),
        F.count_if(F.col("n_events") == 1).alias("bounced_users"),
    )
    return v.select(
        "variant", "users", "views", "clicks", "buyers", "purchases", "revenue", "bounced_users",
        safe_ratio(F.col("clicks"), F.col("views")).alias("ctr"),
        safe_ratio(F.col("buyers"), F.col("users")).alias("cvr"),
        safe_ratio(F.col("revenue"), F.col("purchases")).alias("aov"),
        safe_ratio(F.col("bounced_users"), F.col("users")).alias("bounce_rate"),
    )


def _wide(rates: DataFrame) -> DataFrame:
    """Two-row per-variant frame -> one row with _c / _t columns."""
    cols = [c for c in rates.columns if c != "variant"]
    aggs = []
    for c in cols:
        aggs.append(F.max(F.when(F.col("variant") == CONTROL, F.col(c))).alias(f"{c}_c"))
        aggs.append(F.max(F.when(F.col("variant") == TREATMENT, F.col(c))).alias(f"{c}_t"))
    return rates.agg(*aggs)


def two_proportion(x1: Column, n1: Column, x2: Column, n2: Column) -> dict[str, Column]:
    """Pooled two-proportion z-test of p2 vs p1 with a 95 % interval of p2 - p1."""
    p1, p2 = x1.cast("double") / n1, x2.cast("double") / n2
    pool = (x1 + x2).cast("double") / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = (p2 - p1) / F.nullif(se, F.lit(0.0))
    se_u = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    diff = p2 - p1
    return {
        "p_control": p1, "p_treatment": p2, "abs_uplift": diff,
        "rel_uplift": diff / F.nullif(p1, F.lit(0.0)), "z": z, "p_value": normal_two_sided_p(z),
        "ci_low": diff - Z_95 * se_u, "ci_high": diff + Z_95 * se_u,
    }


def ab_two_proportion_test(events: DataFrame) -> DataFrame:
    """CVR treatment vs control: z, two-sided p, 95 % CI, absolute and relative uplift."""
    w = _wide(ab_rates(events))
    t = two_proportion(F.col("buyers_c"), F.col("users_c"), F.col("buyers_t"), F.col("users_t"))
    return w.select("users_c", "users_t", "buyers_c", "buyers_t", *[r6(c).alias(k) for k, c in t.items()])


def ab_srm_check(events: DataFrame, expected_share: float = 0.5) -> DataFrame:
    """Sample-ratio mismatch: chi-square (1 d.o.f.) of users per variant vs the declared split."""
    w = _wide(ab_rates(events).select("variant", "users"))
    n = F.col("users_c") + F.col("users_t")
    ec, et = n * expected_share, n * (1 - expected_share)
    chi = (F.col("users_c") - ec) ** 2 / ec + (F.col("users_t") - et) ** 2 / et
    return w.select("users_c", "users_t", r6(chi).alias("chi_square"), r6(chi2_1dof_p(chi)).alias("p_value"),
                    (chi2_1dof_p(chi) >= 0.05).alias("passed"))


def user_ndcg(events: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """NDCG@k of every user with a positive ideal: variant, user_id, ndcg_at_k.

    A user's events in time order are the ranked list; relevance is
    purchase 3, click 2, view 1, other 0.  DCG@k = sum rel / log2(rank+1)
    over the first k; IDCG@k the same over the k highest relevances; users
    with IDCG 0 have null.  ``row_number() <= k`` lets Spark insert a
    partial per-group limit before the shuffle (map-side top-k), so a hot
    user sends at most k rows per task.
    """
    kmax = max(ks)
    rel = F.lit(0)
    for name, g in RELEVANCE.items():
        rel = F.when(F.col("event_type") == name, g).otherwise(rel)
    e = assign_variant(events).select("variant", "user_id", "event_id", "ts", rel.alias("rel"))
    by_time = Window.partitionBy("variant", "user_id").orderBy("ts", "event_id")
    by_rel = Window.partitionBy("variant", "user_id").orderBy(F.desc("rel"), "event_id")
    disc = 1 / F.log2(F.col("pos") + 1)
    actual = (e.withColumn("pos", F.row_number().over(by_time)).where(F.col("pos") <= kmax)
              .select("variant", "user_id", "pos", (F.col("rel") * disc).alias("g")))
    ideal = (e.withColumn("pos", F.row_number().over(by_rel)).where(F.col("pos") <= kmax)
             .select("variant", "user_id", "pos", (F.col("rel") * disc).alias("ig")))
    aggs = []
    for k in ks:
        aggs.append(F.sum(F.when(F.col("pos") <= k, F.col("g"))).alias(f"dcg{k}"))
    a = actual.groupBy("variant", "user_id").agg(*aggs)
    i = ideal.groupBy("variant", "user_id").agg(*[F.sum(F.when(F.col("pos") <= k, F.col("ig"))).alias(f"idcg{k}")
                                                  for k in ks])
    return a.join(i, ["variant", "user_id"]).select(
        "variant", "user_id", *[(F.col(f"dcg{k}") / F.nullif(F.col(f"idcg{k}"), F.lit(0.0))).alias(f"ndcg_at_{k}") for k in ks])


def ab_ndcg_at_k(events: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Mean NDCG@k per variant over users with a positive ideal."""
    out = user_ndcg(events, ks).groupBy("variant").agg(*[F.avg(f"ndcg_at_{k}").alias(f"ndcg_at_{k}") for k in ks])
    return out.select("variant", *[r6(F.col(f"ndcg_at_{k}")).alias(f"ndcg_at_{k}") for k in ks])


def ab_cvr_daily(events: DataFrame) -> DataFrame:
    """Per day and variant: active users, buyers, CVR."""
    e = assign_variant(events).withColumn("day", F.to_date("ts"))
    u = e.groupBy("day", "variant", "user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"))
    g = u.groupBy("day", "variant").agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("p") > 0).alias("buyers"))
    return g.withColumn("cvr", safe_ratio(F.col("buyers"), F.col("users")))


def ab_metric_table(events: DataFrame) -> DataFrame:
    """The ledger's six rows: metric, control, treatment, uplifts, p-value.

    The tests are those of :func:`souq.operators.significance.ab_significance`.
    """
    from .significance import ab_significance
    return ab_significance(events).select("metric", "control", "treatment", "abs_uplift", "rel_uplift", "p_value")
