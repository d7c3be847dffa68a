"""Skew-safe positions within groups.

A window ``partitionBy(g)`` runs each group in one task, so a group holding
a third of the rows lands whole in one task.  :func:`value_ranks` splits large
groups before any per-group ordering.  It works on the (group, value) histogram
(ties collapse map-side).  A group of up to ``BUCKET_VALUES`` values is one
bucket and costs one window; a larger one is cut at points of a bounded
``percentile_approx`` sketch of that group, and a part that is still too large
is cut again by a sketch of its own, until all parts fit.  Rows are dealt out
anew by (group, bucket), and the counts of a group's buckets are combined with
a window inside each bucket.  The result is exact; the sketches only balance
the buckets.

Groups are compared null-safely: the NULL group is a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def join_groups(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equal or both-NULL columns; the right side's copies of them are dropped."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in cols])
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in cols])


#: values that one bucket holds: a group of no more is not split
BUCKET_VALUES = 100_000

#: a sketch balances this many parts; a larger group is split in several rounds
PARTS = 256

#: cut points are searched in steps of this many, then one by one
STEP = 16

#: values of a histogram for each of its tasks: they are few bytes, but each is searched, ordered and joined
TASK_VALUES = 50_000


def _part(v: Column) -> Column:
    """How many of the sorted ``_cuts`` lie below the value."""
    coarse = F.size(F.filter("_coarse", lambda c: c < v)) * STEP
    return F.coalesce(coarse + F.size(F.filter(F.slice("_cuts", coarse + 1, STEP), lambda c: c < v)), F.lit(0))


def _tasks(hist: DataFrame, values: int, at: list[str]) -> DataFrame:
    """Dealt out for the work that each value is: its few bytes alone would be one task."""
    return hist.repartition(max(hist.sparkSession.sparkContext.defaultParallelism, -(-values // TASK_VALUES)), *at)


def _split(hist: DataFrame, keys: list[str], bucket_values: int) -> DataFrame:
    """``hist``, materialised, with ``_b``: the number of the row's part of its group, ascending with the value.

    ``_b`` is part of what is materialised: as a constant in the plan it would
    be folded away, and with it the keys that deal rows out and join counts.
    Each round looks at the parts with more than ``bucket_values`` values, and
    only at them: a group's few cut points go to its own rows.  There is one
    such part for at least ``bucket_values`` values, so their points are few
    enough to go to every task.
    """
    at = [*keys, "_b"]
    out = cut_lineage(hist.withColumn("_b", F.lit(0).cast("decimal(38,0)")))
    last = None
    while True:
        large = out.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_values)
        found = cut_lineage(large)
        left = tuple(found.agg(F.count(F.lit(1)), F.sum("_n")).first())
        # a round that splits nothing ends it: sketches cannot tell the values apart
        if not left[0] or left == last:
            return out
        if last is None:
            out = _tasks(out, left[1], [*keys, "_v"])
        last = left
        v = F.col("_v").cast("double")
        points = join_groups(out, F.broadcast(found), at).groupBy(*at).agg(
            F.array_distinct(F.percentile_approx(v, [i / PARTS for i in range(1, PARTS)], 4 * PARTS)).alias("_cuts")) \
            .withColumn("_coarse", F.filter("_cuts", lambda c, i: i % STEP == STEP - 1))
        cut = join_groups(out, F.broadcast(points), at, "left")
        out = cut_lineage(cut.withColumn("_b", (F.col("_b") * PARTS + _part(v)).cast("decimal(38,0)")).drop("_cuts", "_coarse"))


def value_ranks(df: DataFrame, group_cols: list[str], value_col: str, descending: bool = False,
                bucket_values: int = BUCKET_VALUES) -> DataFrame:
    """One row per (group, distinct non-NULL value) with

    * ``n_before``: rows of the group strictly before the value in the
      requested order (so ``rank() = n_before + 1``),
    * ``n_equal``: rows with this value,
    * ``n_group``: rows in the group.
    """
    v = F.col(value_col)
    hist = df.where(v.isNotNull()).groupBy(*group_cols, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # the histogram feeds the sizes, the sketches, the bucket counts and the
    # in-bucket window: materialise it once (reliable checkpoint, shared
    # folder) so the upstream plan is not recomputed for every branch
    h = _split(hist, group_cols, bucket_values)
    # An earlier exchange may leave a group in one task, which would satisfy the
    # windows below without another: deal the buckets out explicitly.
    h = h.repartition(*group_cols, "_b")
    per_b = h.groupBy(*group_cols, "_b").agg(F.sum("_c").alias("_bc"))
    b_order = F.desc("_b") if descending else F.asc("_b")
    whole = Window.partitionBy(*group_cols)
    w_b = whole.orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
    offs = per_b.select(*group_cols, "_b", F.coalesce(F.sum("_bc").over(w_b), F.lit(0)).alias("_off"), F.sum("_bc").over(whole).alias("n_group"))
    v_order = F.desc("_v") if descending else F.asc("_v")
    w_v = Window.partitionBy(*group_cols, "_b").orderBy(v_order).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_in", F.coalesce(F.sum("_c").over(w_v), F.lit(0)))
    return join_groups(h, offs, [*group_cols, "_b"]).select(
        *group_cols, F.col("_v").alias(value_col),
        (F.col("_off") + F.col("_in")).cast("long").alias("n_before"),
        F.col("_c").alias("n_equal"), F.col("n_group").cast("long").alias("n_group"))


def skew_safe_rank(df: DataFrame, group_cols: list[str], value_col: str, descending: bool = True,
                   out: str = "rank", **kw) -> DataFrame:
    """``rank()`` within groups by ``value_col`` (NULL values get NULL rank).

    ``df`` is read twice (histogram and join-back); pass a materialised
    frame when it is expensive to recompute.
    """
    r = value_ranks(df, group_cols, value_col, descending, **kw)
    r = r.select(*group_cols, value_col, (F.col("n_before") + 1).cast("int").alias(out))
    return join_groups(df, r, [*group_cols, value_col], "left")
