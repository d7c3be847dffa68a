"""What large tables move: few keys go to the rows, rows are dealt out once, plans are not run again."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from souq.functions.ranks import _split
from souq.operators import inventory as IV
from souq.operators import ml as ML
from souq.operators.quality import propagate_delete
from souq.plans import stored_marts as SM
from souq.session import keep_keys
from souq.sources.sinks import written_once
from souq.sources.stored import Load


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_keys_go_to_the_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    keys = rows.where("k % 7 = 0")
    kept, few = keep_keys(keys)
    left = propagate_delete(rows, "k", kept, "CASCADE")
    assert few and "SortMergeJoin" not in executed(left) and left.count() == 857
    nulled = propagate_delete(rows, "k", kept, "SET NULL")
    assert "SortMergeJoin" not in executed(nulled) and nulled.where("k is null").count() == 143
    kept, few = keep_keys(keys, most=10)
    assert not few and propagate_delete(rows, "k", kept, "CASCADE").count() == 857


def test_placed_rows_are_few_files_and_all_of_them(spark, tmp_path):
    base = str(tmp_path / "placed")
    load = Load(spark, base)
    load.stage_table("t", spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("m")), "m")
    load.commit()
    files = lambda: {d: sum(f.endswith(".parquet") for f in os.listdir(f"{base}/t/{d}")) for d in os.listdir(f"{base}/t") if "=" in d}
    before = files()
    load = Load(spark, base)
    load.stage_partitions("t", spark.read.parquet(f"{base}/t").where("id % 10 <> 0"), "m", [0, 1, 2], placed=True)
    load.commit()
    assert files() == before and spark.read.parquet(f"{base}/t").count() == 270


def test_partials_do_not_depend_on_the_parts(spark):
    day = F.lit(19950101) + (F.col("id") % 3) * 100 + F.col("id") % 28
    orders = spark.range(400).select(
        (F.col("id") / 2).cast("long").alias("order_id"), day.cast("int").alias("date_id"),
        F.when(F.col("id") % 9 != 0, F.col("id") % 5).alias("store_id"), (F.col("id") % 11).alias("customer_id"),
        *[(F.col("id") % 13).cast("decimal(10,2)").alias(c) for c in ("gross_amount", "discount_amount", "vat_amount", "net_amount")],
        (day / 100).cast("int").alias(SM.MONTH_COL))
    sales = spark.range(400).select(
        (F.col("id") % 17).alias("product_id"), (F.col("id") % 4).cast("int").alias("quantity"),
        *[(F.col("id") % 13).cast("decimal(10,2)").alias(c) for c in ("gross_sales", "item_cost", "gross_profit")],
        (F.lit(199501) + F.col("id") % 3).cast("int").alias(SM.MONTH_COL))
    one, three = SM.partials(orders, sales), SM.partials(orders, sales, (3, 3))
    for name in SM.PARTIALS:
        estimates = [c for c in one[name].columns if c.endswith("_sketch")]
        got = [sorted(map(str, p.withColumns({c: F.hll_sketch_estimate(c) for c in estimates}).collect())) for p in (one[name], three[name])]
        assert got[0] == got[1] and got[0]
        assert executed(three[name]).count("hashpartitioning") == 1  # rows are dealt out once


def test_a_large_group_is_split_in_many_tasks(spark):
    n = 3000
    hist = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("_v"), F.lit(1).alias("_c")).coalesce(1)
    out = _split(hist, ["g"], 100)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    parts = out.groupBy("_b").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("n")).orderBy("_b").collect()
    assert sum(p.n for p in parts) == n and max(p.n for p in parts) <= 100
    assert all(a.hi < b.lo for a, b in zip(parts, parts[1:]))


def test_forest_tasks_hold_a_bounded_number_of_rows(spark):
    assert ML.stable_layout(spark.range(5), "id", 100_000).rdd.getNumPartitions() == 10


def test_written_once_is_the_same_rows_without_their_plan(spark):
    df = spark.createDataFrame([(1, None, dt.date(2000, 1, 1)), (None, "x", None), (1, None, dt.date(2000, 1, 1))], "a int, b string, d date")
    again = written_once(df.repartition(3, "a"))
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect())) and again.schema == df.schema
    assert "Exchange" not in executed(again)


def test_ledger_reads_its_movements_from_one_copy(spark):
    sales = spark.createDataFrame([(1, 10, 5, 19990101, 2, 8.0), (1, 11, 5, 19990102, 1, 4.0)],
                                  "order_id long, order_item_id long, product_id long, date_id int, quantity int, gross_sales double")
    returns = spark.createDataFrame([(10, 1, 5, "Approved", 4.0, dt.datetime(1999, 1, 3))],
                                    "return_id long, order_id long, product_id long, return_status string, refund_amount double, requested_at timestamp")
    stock = spark.createDataFrame([(1, 5, 20, 3)], "inventory_id long, product_id long, stock_quantity int, reorder_level int")
    ledger = IV.inventory_ledger(stock, sales, returns)
    assert "return_status" not in executed(ledger)
    assert [r.balance_after for r in ledger.orderBy("moved_on").collect()] == [20, 19, 20]
