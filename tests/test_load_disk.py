"""What a load deals out and what it leaves on disk."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from souq.plans import build as BLD
from souq.plans import warehouse as W
from souq.session import checkpoint_dir
from souq.sources.stored import Load

SCHEMA = f"order_id long, amount int, note string, {BLD.MONTH_COL} int"


def rows(df):
    return sorted(map(repr, df.collect()))


def shuffle_files(spark):
    """Names of the shuffle files on this machine's disks."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def copies(spark):
    """Files of the copies that loads have written for themselves."""
    at = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "souq-work", "once")
    return {os.path.join(d, f) for d, _, names in os.walk(at) for f in names}


def test_an_upsert_by_month_is_the_upsert_by_key(spark, tmp_path, monkeypatch):
    old = [(1, 1, "a", 199501), (1, 1, "a", 199501), (2, 2, None, 199501), (2, 3, "b", 199501), (3, 3, "c", 199502), (3, 9, "c", 199503),
           (4, 4, "d", 199502), (5, 5, "e", 199503), (None, 6, "f", 199501), (None, 6, "f", 199501), (6, 1, "g", 199504), (7, 7, "h", 199505)]
    new = [(2, 8, "x", 199501), (2, 8, None, 199501), (2, None, "z", 199501), (3, 1, "x", 199502), (5, 5, "y", 199502), (5, 5, "z", 199501),
           (None, 1, "n", 199502), (None, 2, "n", 199503), (8, 1, "i", 199506), (8, 1, "i", 199506), (9, 2, "k", 199506), (9, 1, "l", 199501)]
    for per_part, per_slice in ((250_000, 150_000_000), (1, 3)):
        monkeypatch.setattr(BLD, "ROWS_PER_PART", per_part)
        monkeypatch.setattr(BLD, "ROWS_PER_SLICE", per_slice)
        base = str(tmp_path / str(per_part))
        load = Load(spark, base)
        load.stage_table("t", spark.createDataFrame(old, SCHEMA), BLD.MONTH_COL)
        load.commit()
        stored = spark.read.schema(SCHEMA).parquet(f"{base}/t")
        batch = spark.createDataFrame(new, SCHEMA)
        for again in range(2):
            want = rows(W.upsert_by_key(stored, batch, ["order_id"]).where(F.col("order_id").isNotNull() | (F.lit(again) == 0)))
            load = Load(spark, base)
            months = BLD._stage_upsert(load, "t", "order_id", batch, stored)
            load.commit()
            stored = spark.read.schema(SCHEMA).parquet(f"{base}/t")
            assert rows(stored.where(F.col("order_id").isNotNull() | (F.lit(again) == 0)).select(*batch.columns)) == want
            assert months == [199501, 199502, 199503, 199506]
        assert os.path.isdir(f"{base}/t/{BLD.MONTH_COL}=199504")


def test_an_upsert_deals_rows_out_once(spark):
    one = spark.range(1000).select(F.col("id").alias("order_id"), F.lit(1).alias("amount"), F.lit("a").alias("note"),
                                   (F.lit(199501) + F.col("id") % 5).cast("int").alias(BLD.MONTH_COL))
    out = BLD._upsert_in_months(one, one.where("order_id % 3 = 0"), "order_id", {199501 + m: 200 for m in range(5)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan and out.count() == 1000


def test_months_are_loaded_a_few_at_a_time():
    assert BLD._slices({3: 4, 1: 5, 2: 5, 4: 20, 5: 1}, 10) == [[1, 2], [3], [4], [5]]
    assert BLD._slices({}, 10) == []


def test_a_load_leaves_no_shuffle_files_and_no_copies(spark, tmp_path):
    base = str(tmp_path)
    fact = spark.range(3000).select(F.col("id").alias("order_id"), F.lit(1).alias("amount"), F.lit("a").alias("note"),
                                    (F.lit(199501) + F.col("id") % 5).cast("int").alias(BLD.MONTH_COL))
    files, kept = shuffle_files(spark), copies(spark)
    load = Load(spark, base)
    load.stage_table("t", fact, BLD.MONTH_COL)
    load.commit()
    assert shuffle_files(spark) <= files
    load = Load(spark, base)
    BLD._stage_upsert(load, "t", "order_id", fact, spark.read.schema(fact.schema).parquet(f"{base}/t"))
    load.commit()
    assert shuffle_files(spark) <= files and copies(spark) <= kept
    assert spark.read.parquet(f"{base}/t").count() == 3000
