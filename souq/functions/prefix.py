"""Running sums and last values along time without ordering a whole entity in one task.

A window ``partitionBy(entity).orderBy(time)`` sorts all rows of an entity in
one task.  Here an entity's time line is cut into buckets: every bucket is
reduced to one row (its total, or its last value), a window over those few
rows gives what each bucket begins with, and the rows are ordered inside their
bucket only.  A hot entity is as many tasks as it has buckets.  The windows
and the join share one dealing of the rows, by (entity, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import join_groups


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the entity's rows up to and including this one.

    ``order`` must order an entity's rows totally and ``bucket`` must not fall along it.
    Null keys are an entity; null values add nothing.
    """
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return join_groups(summed, starts, [*keys, "_bucket"]) \
        .withColumn(name, F.col("_start") + F.col("_inside")).select(*df.columns, name)


def last_known(points: DataFrame, facts: DataFrame, keys: list[str], bucket) -> DataFrame:
    """As-of join: for every (keys, at) of ``points`` the latest ``fact`` of the entity not after ``at``.

    ``points`` has keys and at; ``facts`` has keys, at and fact (a struct, one
    row per entity and time).  ``bucket(at)`` cuts the time line.  Returns
    points with fact and fact_at, null where the entity has none yet.
    """
    both = points.select(*keys, "at", F.lit(None).cast(facts.schema["fact"].dataType).alias("fact"), F.lit(True).alias("_ask")) \
        .union(facts.select(*keys, "at", "fact", F.lit(False))) \
        .withColumn("_bucket", bucket(F.col("at")))
    last = F.max_by(F.struct(F.col("at").alias("fact_at"), "fact"), F.when(~F.col("_ask"), F.col("at")))
    ends = both.where("not _ask").groupBy(*keys, "_bucket").agg(last.alias("_end"))
    # what the buckets before this one end with; a bucket that is only asked about needs it too
    asked = both.where("_ask").select(*keys, "_bucket").distinct()
    line = asked.select(*keys, "_bucket", F.lit(None).cast(ends.schema["_end"].dataType).alias("_end")).union(ends) \
        .groupBy(*keys, "_bucket").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = line.select(*keys, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    # in a bucket, facts of a moment come before the points of that moment
    inside = Window.partitionBy(*keys, "_bucket").orderBy("at", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last(F.when(~F.col("_ask"), F.struct(F.col("at").alias("fact_at"), "fact")), ignorenulls=True).over(inside))
    found = join_groups(seen.where("_ask"), starts, [*keys, "_bucket"]).withColumn("_known", F.coalesce("_seen", "_start"))
    return found.select(*keys, "at", F.col("_known.fact").alias("fact"), F.col("_known.fact_at").alias("fact_at"))
