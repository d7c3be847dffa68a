"""Warehouse build and load jobs (E1) and a star schema read back from written tables.

``build_warehouse`` writes the four dimensions and two facts to Parquet under
one base folder, in one :class:`~souq.sources.stored.Load`: all tables change
or none.  Facts are partitioned by order month, so date-bounded marts prune
files and a load touches only the months it has to; dimensions are small
relative to facts and are written unpartitioned.  ``WrittenStar`` serves the
same lazy interface as :class:`souq.plans.star.Star` from those files, so
marts and metrics run on materialised tables instead of recomputing the
warehouse from the operational data every time.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import date_from_key
from ..session import keep_keys, shuffles_end_with_actions
from ..sources.constraints import WAREHOUSE_KEYS
from ..sources.sinks import WAREHOUSE_SCHEMAS, conform, written_while
from ..sources.stored import Load, recover
from . import warehouse as W
from .star import Star

MONTH_COL = "order_month"
FACTS = ("dw_fact_sales", "dw_fact_orders")
ALL_MONTHS = "*"


def with_month(fact: DataFrame) -> DataFrame:
    return fact.withColumn(MONTH_COL, (F.col("date_id") / 100).cast("int"))


def _warehouse_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {n: conform(df, WAREHOUSE_SCHEMAS[n]) for n, df in tables.items() if n in WAREHOUSE_SCHEMAS}


def build_warehouse(star: Star, base: str, incremental: bool = False) -> dict[str, str]:
    """Write dims and facts; returns table name -> path.

    ``incremental`` upserts the star's rows into the stored tables by their
    keys instead of replacing them (:func:`load_batch`).
    """
    spark = star.d.spark
    tables = _warehouse_tables(star.tables())
    if incremental:
        load_batch(spark, base, tables)
    else:
        load = Load(spark, base)
        for name, df in tables.items():
            if name in FACTS:
                load.stage_table(name, with_month(df), MONTH_COL)
            else:
                load.stage_table(name, df)
        load.mark(stale=[ALL_MONTHS])
        load.commit()
    return {name: os.path.join(base, name) for name in tables}


#: batch and stored rows of a month's part, which one task sorts by key
ROWS_PER_PART = 250_000
#: batch and stored rows that are dealt out at a time: their shuffle is on the executors' disks together
ROWS_PER_SLICE = 150_000_000


def _months(df: DataFrame) -> set[int]:
    """The different months of some rows: a few hundred at most, whatever the rows."""
    return {r[0] for r in df.select(MONTH_COL).distinct().collect()}


def _rows_by_month(df: DataFrame) -> dict[int, int]:
    """The different months of some rows, a few hundred at most whatever the rows, and how many each has."""
    return {r[0]: r[1] for r in df.groupBy(MONTH_COL).agg(F.count(F.lit(1))).collect()}


def _moved_keys(rows: DataFrame, old: DataFrame | None, key: str) -> DataFrame:
    """The batch's keys whose rows, stored ones or its own, are not all of one month."""
    seen = rows.select(key, MONTH_COL, F.lit(True).alias("_new"))
    if old is not None:
        seen = seen.unionByName(old.select(key, MONTH_COL, F.lit(False).alias("_new")))
    by_key = seen.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(MONTH_COL).alias("_lo"), F.max(MONTH_COL).alias("_hi"), F.max("_new").alias("_new"))
    return by_key.where(F.col("_new") & (F.col("_lo") != F.col("_hi"))).select(key)


def _slices(months: dict[int, int], rows: int) -> list[list[int]]:
    """Months in turn, together up to ``rows`` rows; a larger one is alone."""
    out: list[list[int]] = []
    held = 0
    for m in sorted(months):
        if out and held + months[m] <= rows:
            out[-1].append(m)
            held += months[m]
        else:
            out.append([m])
            held = months[m]
    return out


def _upsert_in_months(old: DataFrame | None, new: DataFrame, key: str, months: dict[int, int]) -> DataFrame:
    """``W.upsert_by_key`` of rows whose key is in one month only, dealt out once, by month and part of the key.

    The result is laid out as it is written.  Rows without a key replace
    nothing and are all kept.  ``months`` has the number of rows of each.
    """
    rest = [c for c in new.columns if c not in (key, MONTH_COL)]
    both = new.withColumn("_new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn("_new", F.lit(0)))
    parts = F.create_map(*[F.lit(x) for m, n in months.items() for x in (m, -(-n // ROWS_PER_PART) or 1)])[F.col(MONTH_COL)]
    dealt_by = F.when(F.col(key).isNull(), F.xxhash64(*rest)).otherwise(F.xxhash64(key))
    dealt = both.withColumn("_part", F.pmod(dealt_by, parts).cast("int")).repartition(MONTH_COL, "_part")
    # the batch's greatest row of a key comes first; stored rows stay where there is none
    w = Window.partitionBy(MONTH_COL, "_part", key).orderBy(F.desc("_new"), *[F.desc(c) for c in rest])
    ranked = dealt.withColumns({"_place": F.row_number().over(w), "_newest": F.first("_new").over(w)})
    stays = F.col(key).isNull() | (F.col("_newest") == 0) | (F.col("_place") == 1)
    return ranked.where(stays).select(*new.columns)


def load_batch(spark: SparkSession, base: str, batch: dict[str, DataFrame]) -> dict[str, list[int]]:
    """Upsert a batch of rows by key; facts are rewritten only in the months the batch touches.

    ``batch`` has rows of any of the warehouse tables.  Stored rows with a key
    of the batch are replaced, others stay, new keys are added.  The touched
    months of a fact are those of the batch's rows and those that hold a
    stored row with one of its keys (an order whose date moved leaves its old
    month).  Finding the latter reads the key column alone; only touched
    months are read in full, all others keep their files.  The whole batch
    becomes visible at once, or not at all.  Returns the touched months of each fact.
    """
    keys = dict(WAREHOUSE_KEYS)
    load = Load(spark, base)
    stored = WrittenStar(spark, base, None)
    touched: dict[str, list[int]] = {}
    for name, df in batch.items():
        df, key = conform(df, WAREHOUSE_SCHEMAS[name]), keys[name]
        there = load.files.exists(os.path.join(base, name))
        if name not in FACTS:
            load.stage_table(name, W.upsert_by_key(stored._read(name), df, [key]) if there else df)
            continue
        with written_while(with_month(df)) as rows:  # read for its months, its keys and its rows
            touched[name] = _stage_upsert(load, name, key, rows, stored._read(name, keep_month=True) if there else None)
    load.mark(stale=[str(m) for months in touched.values() for m in months])
    load.commit()
    return touched


def _stage_upsert(load: Load, name: str, key: str, rows: DataFrame, old: DataFrame | None) -> list[int]:
    """Stage the months of a fact that some rows touch, with the rows in place; returns those months.

    Keys whose rows are all of one month, nearly all of them, need no more
    than their month's rows, which are dealt out once for lookup and writing;
    the others are looked up everywhere.
    """
    with shuffles_end_with_actions(load.spark):
        moved, _ = keep_keys(_moved_keys(rows, old, key))
        counts = _rows_by_month(rows)
        if old is not None:
            months = sorted({*counts, *_rows_by_month(old.select(key, MONTH_COL).join(moved, key, "left_semi"))})
            there = _rows_by_month(old.where(F.col(MONTH_COL).isin(months)))
            old = old.join(moved, key, "left_anti")
        else:
            months, there = sorted(counts), {}
    counts = {m: counts.get(m, 0) + there.get(m, 0) for m in months}
    apart = rows.where(F.col(key).isNull()).unionByName(rows.join(moved, key, "left_semi").select(*rows.columns))
    with written_while(W.upsert_by_key(rows.limit(0), apart, [key])) as last:
        new = rows.where(F.col(key).isNotNull()).join(moved, key, "left_anti").select(*rows.columns).unionByName(last)
        for part in _slices(counts, ROWS_PER_SLICE):
            of = F.col(MONTH_COL).isin(part)
            now = old.where(of).select(*rows.columns) if old is not None else None
            load.stage_partitions(name, _upsert_in_months(now, new.where(of), key, {m: counts[m] for m in part}), MONTH_COL, part, placed=True)
    return months


class WrittenStar:
    """Star-schema accessors over tables written by :func:`build_warehouse`."""

    def __init__(self, spark: SparkSession, base: str, as_of):
        self.spark, self.base, self.as_of = spark, base, as_of

    def _read(self, name: str, keep_month: bool = False) -> DataFrame:
        recover(self.spark, self.base)
        schema = WAREHOUSE_SCHEMAS[name]
        if name in FACTS:  # a copy: StructType.add mutates in place
            schema = T.StructType(list(schema.fields) + [T.StructField(MONTH_COL, T.IntegerType())])
        df = self.spark.read.schema(schema).parquet(os.path.join(self.base, name))
        return df if keep_month or name not in FACTS else df.drop(MONTH_COL)

    @cached_property
    def dim_merchant(self) -> DataFrame:
        return self._read("dw_dim_merchant")

    @cached_property
    def dim_store(self) -> DataFrame:
        return self._read("dw_dim_store")

    @cached_property
    def dim_customer(self) -> DataFrame:
        return self._read("dw_dim_customer")

    @cached_property
    def dim_product(self) -> DataFrame:
        return self._read("dw_dim_product")

    @cached_property
    def fact_sales(self) -> DataFrame:
        return self._read("dw_fact_sales")

    @cached_property
    def fact_orders(self) -> DataFrame:
        return self._read("dw_fact_orders")

    @cached_property
    def dim_date(self) -> DataFrame:
        return W.dim_date_for(self.fact_orders, date_from_key("date_id"))

    def fact_orders_between(self, first_month: int, last_month: int) -> DataFrame:
        """Orders of months [first, last] (yyyyMM): only those partitions are read."""
        df = self._read("dw_fact_orders", keep_month=True)
        return df.where(F.col(MONTH_COL).between(first_month, last_month)).drop(MONTH_COL)
