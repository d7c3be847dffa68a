"""Erasure that reaches stored tables.

``quality.erase`` gives the tables as they are after keys are deleted; here the
stored tables are changed.  Only the key columns are read to find the
partitions that hold a row to delete or to null; only those partitions are
read in full and rewritten, in every table that the foreign keys reach and in
the warehouse tables made from them.  All of it is one
:class:`~souq.sources.stored.Load`: an erasure that is interrupted has either
not happened or is finished by the next read or write, so no table is left
with rows whose parents are gone.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import deleted_by_cascade, nulled_edges, propagate_delete
from ..session import keep_keys
from ..sources.constraints import FOREIGN_KEYS, PRIMARY_KEYS, WAREHOUSE_KEYS
from ..sources.stored import Files, Load, recover
from .build import FACTS, MONTH_COL

PART = "part"

#: the date that places a row of an operational table; tables without one are a single folder
PLACED_BY = {"orders": "order_date", "order_items": "ship_date", "payments": "paid_at", "shipments": "shipped_at",
             "returns": "requested_at", "customer_sessions": "session_date"}

#: warehouse table -> the operational table whose key it has
MADE_FROM = {"dw_dim_merchant": "merchants", "dw_dim_store": "stores", "dw_dim_customer": "customers",
             "dw_dim_product": "products", "dw_fact_orders": "orders", "dw_fact_sales": "order_items"}


def _place(table: str) -> Column:
    """Month of the row's date as yyyyMM; rows without a date are in partition 0."""
    return F.coalesce(F.date_format(PLACED_BY[table], "yyyyMM").cast("int"), F.lit(0))


def store_operational(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> None:
    """Write operational tables under ``base``, those with a date partitioned by its month."""
    load = Load(spark, base)
    for name, df in tables.items():
        if name in PLACED_BY:
            load.stage_table(name, df.withColumn(PART, _place(name)), PART)
        else:
            load.stage_table(name, df)
    load.commit()


def read_stored(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A stored operational table, with its partition column."""
    recover(spark, base)
    return spark.read.parquet(os.path.join(base, name))


def _hit_partitions(df: DataFrame, column: str, keys: list[tuple[str, DataFrame]]) -> list[int]:
    """The partitions with a row whose key is among the given ones: a few hundred at most."""
    parts: set[int] = set()
    for key, gone in keys:
        hit = df.select(key, column).join(gone.select(F.col(gone.columns[0]).alias(key)), key, "left_semi")
        parts |= {r[0] for r in hit.select(column).distinct().collect()}
    return sorted(parts)


def erase_stored(spark: SparkSession, base: str, root: str, deleted_keys: DataFrame, files: Files | None = None) -> dict[str, list]:
    """Delete ``deleted_keys`` (one column, the key of table ``root``) from all tables stored under ``base``.

    CASCADE edges remove child rows, SET NULL edges null the key; rows of the
    warehouse made from a deleted row go too, and the months of derived marts
    are noted.  Returns the partitions rewritten in each table ([] for a
    folder without partitions); tables without a hit are not touched.  Keys
    that are not stored, a table that is not stored, and an erasure done
    before are no error and change nothing.
    """
    load = Load(spark, base, files)
    there = set(load.files.names(base))
    tables = {t: read_stored(spark, base, t) for t in PRIMARY_KEYS if t in there}
    missing = {c for c, _, p, _ in FOREIGN_KEYS} | {p for _, _, p, _ in FOREIGN_KEYS}
    # a table that is not stored has no rows to reach
    for t in (missing | set(PRIMARY_KEYS)) - set(tables):
        columns = {PRIMARY_KEYS[t], *[fk for c, fk, _, _ in FOREIGN_KEYS if c == t]}
        tables[t] = spark.createDataFrame([], ", ".join(f"{c} long" for c in sorted(columns)))
    few: list[bool] = []

    def keep(keys: DataFrame) -> DataFrame:
        kept, small = keep_keys(keys)
        few.append(small)
        return kept

    # each table's keys are read by the lookup, the rewrite and the next tables
    deleted = deleted_by_cascade(tables, root, keep(deleted_keys), keep=keep)
    # few keys leave the rows where they are read, in the files of their partitions
    placed = all(few)
    done: dict[str, list] = {}
    for t in sorted(there & set(PRIMARY_KEYS)):
        nulls = nulled_edges(t, deleted)
        keys = [(fk, deleted[parent]) for fk, parent in nulls] + ([(PRIMARY_KEYS[t], deleted[t])] if t in deleted else [])
        if keys:
            _rewrite(load, t, tables[t], PART if t in PLACED_BY else None, keys, deleted.get(t), nulls, deleted, done, placed)
    for name, key in WAREHOUSE_KEYS:
        source = MADE_FROM[name]
        if name in there and source in deleted:
            gone = deleted[source].select(F.col(PRIMARY_KEYS[source]).alias(key))
            _rewrite(load, name, read_stored(spark, base, name), MONTH_COL if name in FACTS else None, [(key, gone)], gone, [], deleted, done, placed)
    load.mark(stale=sorted({str(m) for n in FACTS for m in done.get(n, [])}))
    load.commit()
    return done


def _rewrite(load: Load, name: str, df: DataFrame, column: str | None, keys: list[tuple[str, DataFrame]],
             gone: DataFrame | None, nulls: list[tuple[str, str]], deleted: dict[str, DataFrame], done: dict[str, list], placed: bool) -> None:
    """Stage the partitions of one table that hold a hit, without the rows that go and with keys nulled."""
    parts = _hit_partitions(df if column else df.withColumn(PART, F.lit(0)), column or PART, keys)
    if not parts:
        return
    left = df.where(F.col(column).isin(parts)) if column else df
    if gone is not None:
        left = propagate_delete(left, gone.columns[0], gone, "CASCADE")
    for fk, parent in nulls:
        left = propagate_delete(left, fk, deleted[parent], "SET NULL")
    if column:
        load.stage_partitions(name, left, column, parts, placed)
    else:
        load.stage_table(name, left)
    done[name] = parts if column else []
