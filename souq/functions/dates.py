"""Date keys and calendar helpers.

Keys are built and parsed with integer arithmetic (no string formatting in
the per-row path).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(ts: Column | str) -> Column:
    """Timestamp/date -> int key yyyyMMdd (the reference's DATE_FORMAT cast)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    d = F.to_date(ts)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def date_from_key(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    k = key.cast("int")
    return F.make_date(F.floor(k / 10000).cast("int"), (F.floor(k / 100) % 100).cast("int"), (k % 100).cast("int"))


def month_end(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.last_day(F.to_date(ts))
