"""Money arithmetic in exact decimals.

Amounts are ``decimal(10,2)`` as in the reference schema; sums widen to
``decimal(20,2)``.  Ratios are computed as double from exact decimal sums
(one IEEE division, so every engine gives the same bits) and are not
rounded for comparison.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(10,2)"
DEC_SUM = "decimal(20,2)"

# Adapter scale for driver money: 0.002 brings TPC-H prices to shop sizes.
MONEY_SCALE = Decimal("0.002")


def money(c: Column | str, scale: Decimal = MONEY_SCALE) -> Column:
    """Double -> decimal(10,2) money: round(dec(12,2)(x) * scale, 2)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(12,2)") * F.lit(scale), 2).cast(DEC)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL (ANSI-safe)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
