"""Exact, interpolated quantiles per group from a value histogram.

``percentile`` (exact) gathers every value of a group into one aggregation
buffer, which fails when one group holds a third of the rows.  Here the
rows are reduced to (group, value, count) with a partial aggregate, so
repeated values collapse map-side, and the cumulative counts come from
:func:`souq.functions.ranks.value_ranks`, which splits every group into
value buckets.  The counts locate the order statistics at
0-based positions floor(q(n-1)) and ceil(q(n-1)); the result is
lo + (q(n-1) - floor(q(n-1))) x (hi - lo), the same linear interpolation
as SQL ``percentile_cont``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import value_ranks


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, qs: dict[str, float]) -> DataFrame:
    """One row per group: ``n`` and a double column per entry of ``qs``."""
    for q in qs.values():
        _check_fraction(q)
    vals = df.select(*group_cols, F.col(value_col).cast("double").alias("_v"))
    h = value_ranks(vals, group_cols, "_v").withColumnsRenamed(
        {"n_before": "_before", "n_equal": "_c", "n_group": "_n"})
    aggs = [F.first("_n").alias("n")]
    for name, q in qs.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        lo_i, hi_i = F.floor(pos), F.ceil(pos)
        at = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_c"))
        aggs += [F.max(F.when(at(lo_i), F.col("_v"))).alias(f"_{name}_lo"),
                 F.max(F.when(at(hi_i), F.col("_v"))).alias(f"_{name}_hi"),
                 F.first(pos - lo_i).alias(f"_{name}_f")]
    g = h.groupBy(*group_cols).agg(*aggs)
    out = [F.col(c) for c in group_cols] + [F.col("n")]
    for name in qs:
        lo, hi, f = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        out.append((lo + f * (hi - lo)).alias(name))
    return g.select(*out)


def five_number_summary(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """min, q1, median, q3, max (exact; quartiles interpolated)."""
    return exact_quantiles(df, group_cols, value_col,
                           {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})


def _check_fraction(q: float) -> None:
    if not (0.0 <= q <= 1.0) or math.isnan(q):
        raise ValueError(f"quantile {q} outside [0, 1]")
