"""Point-in-time feature lookup (X10, X11): the features of an entity as they were known at a label's time.

A training row must not see features computed after its label.  Every feature
row is known from a moment on (``known_at``); a label gets the latest one of
its entity that was known by then, and none that is older than ``max_age``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_from_key
from ..functions.prefix import last_known
from ..functions.ranks import join_groups
from .features import feature_avg_aov_30d, feature_orders_7d


def lookup(labels: DataFrame, features: DataFrame, entity: list[str], label_time: str, known_at: str, values: list[str],
           max_age: str | None = None, bucket: str = "month") -> DataFrame:
    """Labels with the ``values`` of their entity's features as known at ``label_time``, and ``feature_time``.

    Nulls where nothing was known yet, where the last known row is older than
    ``max_age`` (an interval such as '30 days'), and for labels without a
    time.  Feature rows without a time are never known.  Of several feature
    rows of one entity and moment the greatest is taken, so the result is
    repeatable.  Every label stays, repeated ones too.

    Labels of one entity and moment ask once; an entity's time line is cut
    into ``bucket`` units, so a hot entity is not ordered in one task, and the
    answers are joined back by (entity, time), where AQE splits skew.
    """
    ask, known = F.col(label_time).cast("timestamp"), F.col(known_at).cast("timestamp")
    facts = features.where(F.col(known_at).isNotNull()).groupBy(*entity, known.alias("at")).agg(F.max(F.struct(*values)).alias("fact"))
    timed = labels.withColumn("_at", ask)
    points = timed.where(F.col("_at").isNotNull()).select(*entity, F.col("_at").alias("at")).distinct()
    answers = last_known(points, facts, entity, lambda at: F.date_trunc(bucket, at)).withColumnRenamed("at", "_at")
    if max_age:
        fresh = F.col("fact_at") >= F.col("_at") - F.expr(f"INTERVAL {max_age}")
        answers = answers.withColumns({"fact": F.when(fresh, F.col("fact")), "fact_at": F.when(fresh, F.col("fact_at"))})
    joined = join_groups(timed, answers, [*entity, "_at"], "left")
    return joined.select(*labels.columns, *[F.col(f"fact.{v}").alias(v) for v in values], F.col("fact_at").alias("feature_time"))


def merchant_features(fact_orders: DataFrame, d_store: DataFrame) -> DataFrame:
    """Daily merchant features with the day they are known from: the day after the orders they count."""
    aov = feature_avg_aov_30d(fact_orders, d_store)
    week = feature_orders_7d(fact_orders, d_store)
    return aov.join(week, ["merchant_id", "day"]).select(
        "merchant_id", F.date_add("day", 1).alias("known_from"), "net_30d", "orders_30d", "avg_aov_30d", "orders_last_7d")


def features_at_order(fact_orders: DataFrame, d_store: DataFrame, max_age: str | None = None) -> DataFrame:
    """Each order with its merchant's features as known on the order's day (its own day not counted)."""
    labels = fact_orders.join(d_store.select("store_id", "merchant_id"), "store_id") \
        .select("order_id", "merchant_id", date_from_key("date_id").alias("order_day"))
    out = lookup(labels, merchant_features(fact_orders, d_store), ["merchant_id"], "order_day", "known_from",
                 ["net_30d", "orders_30d", "avg_aov_30d", "orders_last_7d"], max_age)
    return out.withColumn("feature_time", F.to_date("feature_time"))
