"""Stored tables: interrupted writes at every point, loads by month, marts kept up with them."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from souq.plans import build as BLD
from souq.plans import marts as M
from souq.plans import stored_marts as SM
from souq.queries import star_for
from souq.session import cut_lineage
from souq.sources import sinks as S
from souq.sources import stored as ST

from .conftest import SMOKE_DIR


class Crash(Exception):
    pass


class Failing(ST.Files):
    """File operations that stop the process after the first ``n`` changes."""

    def __init__(self, spark, base, n):
        super().__init__(spark, base)
        self.left = n

    def _step(self):
        if self.left == 0:
            raise Crash
        self.left -= 1

    def delete(self, path):
        if self.exists(path):
            self._step()
        super().delete(path)

    def rename(self, old, new):
        self._step()
        super().rename(old, new)


def numbers(spark, path):
    return sorted(r[0] for r in spark.read.parquet(path).select("id").collect())


def test_swap_interrupted_anywhere_loses_nothing(spark, tmp_path):
    for n in range(10):
        base = tmp_path / str(n)
        final, staging = str(base / "t"), str(base / "_t__staging")
        spark.range(3).write.parquet(final)
        spark.range(5).write.parquet(staging)
        files = Failing(spark, final, n)
        try:
            ST.swap(spark, staging, final, files)
            done = True
        except Crash:
            done = False
        ST.restore(spark, final)
        assert numbers(spark, final) == list(range(5 if done or not os.path.exists(staging) else 3))
        spark.range(7).write.mode("overwrite").parquet(staging)
        ST.swap(spark, staging, final)
        assert numbers(spark, final) == list(range(7)) and sorted(os.listdir(base)) == ["t"]
        if done:
            break
    assert n == 3  # set aside, renamed in, old one deleted


def month_rows(spark, months, plus=0):
    return spark.createDataFrame([(m * 100 + i + plus, m) for m in months for i in range(3)], "id long, m int")


def test_load_interrupted_anywhere_is_whole_or_not_at_all(spark, tmp_path):
    def content(base):
        return {t: numbers(spark, f"{base}/{t}") if os.path.exists(f"{base}/{t}") else None for t in ("dim", "fact", "new")}
    for n in range(40):
        base = str(tmp_path / str(n))
        first = ST.Load(spark, base)
        first.stage_table("dim", spark.range(3))
        first.stage_table("fact", month_rows(spark, (1, 2, 3)), "m")
        first.mark(stale=["1"])
        first.commit()
        before = content(base)
        kept = sorted(os.listdir(f"{base}/fact/m=1"))

        def change(files=None):
            load = ST.Load(spark, base, files)
            load.stage_table("dim", spark.range(4))
            load.stage_partitions("fact", month_rows(spark, (2, 4), 50), "m", [2, 3, 4])
            load.stage_table("new", spark.range(2))
            load.mark(stale=["2", "4"], fresh=["1"])
            load.commit()
        try:
            change(Failing(spark, base, n))
            done = True
        except Crash:
            done = False
        ST.recover(spark, base)
        after = {"dim": [0, 1, 2, 3], "fact": [100, 101, 102, 250, 251, 252, 450, 451, 452], "new": [0, 1]}
        now = content(base)
        assert now in (before, after)
        assert ST.stale_partitions(spark, base) == ({"2", "4"} if now == after else {"1"})
        assert not os.path.exists(f"{base}/{ST.INTENT}")
        change()
        assert content(base) == after and sorted(os.listdir(f"{base}/fact/m=1")) == kept
        if done:
            break
    assert done and n > 8


def test_rows_outside_the_partitions_to_replace_are_an_error(spark, tmp_path):
    base = str(tmp_path)
    load = ST.Load(spark, base)
    load.stage_table("fact", month_rows(spark, (1, 2)), "m")
    load.commit()
    load = ST.Load(spark, base)
    with pytest.raises(ValueError, match="m=2"):
        load.stage_partitions("fact", month_rows(spark, (1, 2), 9), "m", [1])
    assert numbers(spark, f"{base}/fact") == [100, 101, 102, 200, 201, 202]


def test_a_table_set_aside_by_a_crash_is_not_lost(spark, tmp_path):
    """The state between the two renames of a swap, then an incremental load, a read, a definition."""
    s = star_for(spark, SMOKE_DIR)
    base = str(tmp_path / "w")

    class Early:
        d, as_of = s.d, s.as_of

        def tables(self):
            f = s.fact_orders.where(F.col("date_id") < 19980101)
            return {**s.tables(), "dw_fact_orders": f.union(f.withColumn("order_id", -F.col("order_id") - 1))}
    BLD.build_warehouse(Early(), base)
    stored = BLD.WrittenStar(spark, base, s.as_of).fact_orders.count()
    gone = stored // 2  # rows whose keys the star lacks: they must stay
    shutil.move(f"{base}/dw_fact_orders", f"{base}/dw_fact_orders__old")
    assert BLD.WrittenStar(spark, base, s.as_of).fact_orders.count() == stored
    shutil.move(f"{base}/dw_fact_orders", f"{base}/dw_fact_orders__old")
    S.ensure_tables(spark, base)
    assert BLD.WrittenStar(spark, base, s.as_of).fact_orders.count() == stored
    shutil.move(f"{base}/dw_fact_orders", f"{base}/dw_fact_orders__old")
    BLD.build_warehouse(s, base, incremental=True)
    assert BLD.WrittenStar(spark, base, s.as_of).fact_orders.count() == s.fact_orders.count() + gone
    shutil.move(f"{base}/dw_dim_store", f"{base}/dw_dim_store__old")
    S.truncate_reload(spark, {"dw_dim_store": s.dim_store.limit(3)}, base)
    assert BLD.WrittenStar(spark, base, s.as_of).dim_store.count() == 3


def files_of(path):
    return {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet"))
            for d in os.listdir(path) if d.startswith(BLD.MONTH_COL)}


def test_a_load_keeps_the_files_of_untouched_months(spark, tmp_path):
    s = star_for(spark, SMOKE_DIR)
    base = str(tmp_path / "w")
    BLD.build_warehouse(s, base)
    SM.refresh(spark, base)
    tables = ("dw_fact_orders", "dw_fact_sales", *SM.PARTIALS)
    before = {t: files_of(f"{base}/{t}") for t in tables}
    orders = BLD.WrittenStar(spark, base, s.as_of).fact_orders
    # one order of March 1996 moves to May 1997; all orders of one month leave it
    moved = orders.where(F.col("date_id").between(19960301, 19960331)).orderBy("order_id").limit(1)
    emptied = orders.where(F.col("date_id").between(19990101, 19990131))
    # a frame over the stored files would not outlive them
    batch = cut_lineage(moved.withColumn("date_id", F.lit(19970515)).union(emptied.withColumn("date_id", F.lit(19990215))))
    n = orders.count()
    touched = BLD.load_batch(spark, base, {"dw_fact_orders": batch})
    assert touched == {"dw_fact_orders": [199603, 199705, 199901, 199902]}
    after = {t: files_of(f"{base}/{t}") for t in tables}
    names = {f"{BLD.MONTH_COL}={m}" for m in touched["dw_fact_orders"]}
    assert {d: f for d, f in after["dw_fact_orders"].items() if d not in names} == \
        {d: f for d, f in before["dw_fact_orders"].items() if d not in names}
    assert f"{BLD.MONTH_COL}=199901" not in after["dw_fact_orders"]
    assert all(after["dw_fact_orders"][d] != before["dw_fact_orders"][d] for d in names if d in after["dw_fact_orders"])
    assert after["dw_fact_sales"] == before["dw_fact_sales"]
    ws = BLD.WrittenStar(spark, base, s.as_of)
    assert ws.fact_orders.count() == n and ws.fact_orders.select("order_id").distinct().count() == n
    # the marts follow those months only
    marts = SM.StoredMarts(spark, base)
    with pytest.raises(RuntimeError, match="199603"):
        marts.merchant_daily()
    assert SM.refresh(spark, base) == touched["dw_fact_orders"]
    kept = {t: files_of(f"{base}/{t}") for t in SM.PARTIALS}
    for t in SM.PARTIALS:
        assert {d: f for d, f in kept[t].items() if d not in names} == {d: f for d, f in before[t].items() if d not in names}
    full = M.mart_merchant_daily(ws.fact_orders, ws.dim_store, ws.dim_merchant)
    assert marts.merchant_daily().exceptAll(full).count() == 0 and marts.merchant_daily().count() == full.count()
    rfm = M.mart_customer_rfm(ws.dim_customer, ws.fact_orders, s.as_of)
    assert marts.customer_rfm(s.as_of).exceptAll(rfm).count() == 0
    assert SM.refresh(spark, base) == []
    # the same batch again changes nothing
    BLD.load_batch(spark, base, {"dw_fact_orders": batch})
    again = BLD.WrittenStar(spark, base, s.as_of).fact_orders
    assert again.count() == n and again.join(batch, again.columns, "left_semi").count() == batch.count()


def test_a_load_reads_keys_alone_and_rewrites_touched_months_only(spark, tmp_path):
    s = star_for(spark, SMOKE_DIR)
    base = str(tmp_path / "w")
    BLD.build_warehouse(s, base)
    old = BLD.WrittenStar(spark, base, s.as_of)._read("dw_fact_orders", keep_month=True)
    key_scan = old.select("order_id", BLD.MONTH_COL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_id:bigint>" in key_scan
    month_scan = old.where(F.col(BLD.MONTH_COL).isin([199603]))._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({BLD.MONTH_COL}" in month_scan or f"PartitionFilters: [({BLD.MONTH_COL}" in month_scan


def test_marts_count_distinct_orders_whatever_the_fact_holds(spark):
    s = star_for(spark, SMOKE_DIR)
    twice = s.fact_orders.union(s.fact_orders)
    orders = s.fact_orders.count()
    daily = M.mart_merchant_daily(twice, s.dim_store, s.dim_merchant)
    assert daily.agg(F.sum("total_orders")).first()[0] == orders
    assert M.mart_customer_rfm(s.dim_customer, twice, s.as_of).agg(F.sum("frequency_orders")).first()[0] == orders
    assert M.merchant_overview(s.dim_merchant, s.dim_store, twice).agg(F.sum("total_orders")).first()[0] == orders
