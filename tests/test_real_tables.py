"""What small single-file tables do not show: tables of several files, late rows, rows added later,
NULL groups, very long orders, hot groups."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from souq.functions.quantiles import exact_quantiles
from souq.functions.ranks import value_ranks
from souq.operators import ml as ML
from souq.operators.growth import coupon_usage
from souq.plans import build as BLD
from souq.queries import queries, star_for
from souq.session import checkpoint_dir
from souq.sources import sinks as S
from souq.sources.driver import DRIVER_SCHEMAS, DRIVER_TABLES
from souq.streaming import streams as T

from .conftest import SMOKE_DIR


def copy_tables(target, replace=()):
    os.makedirs(target)
    for t in DRIVER_TABLES:
        if t not in replace:
            os.symlink(f"{SMOKE_DIR}/{t}.parquet", f"{target}/{t}.parquet")
    return str(target)


@pytest.fixture
def parted(spark, tmp_path):
    """orders and events as folders of several files, in an order that is not the order of time."""
    at = copy_tables(tmp_path / "t", ("orders", "events"))
    for t, by in (("orders", "o_orderdate"), ("events", "ts")):
        df = spark.read.schema(DRIVER_SCHEMAS[t]).parquet(f"{SMOKE_DIR}/{t}.parquet")
        df.repartition(4, F.xxhash64(by)).write.parquet(f"{at}/{t}.parquet")
    return at


def test_streams_read_tables_of_several_files(spark, parted, tmp_path):
    got = T.stream_order_counts(spark, parted, str(tmp_path / "s"), str(tmp_path / "c"))
    batch = spark.read.parquet(f"{parted}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("d")).count()
    assert {r.window_start.date(): r.orders for r in got.collect()} == {r.d: r["count"] for r in batch.collect()}
    for name in ("stream_order_counts_append", "stream_purchase_counts", "stream_purchase_counts_append", "stream_dq_checks",
                 "stream_access_log"):
        want = sorted(map(str, queries()[name](spark, SMOKE_DIR).collect()))
        assert sorted(map(str, queries()[name](spark, parted).collect())) == want, name


def test_late_rows_count_within_the_watermark(spark, tmp_path):
    """Two triggers: rows within the watermark of the first are counted, older ones are dropped."""
    os.makedirs(tmp_path / "d" / "orders.parquet")
    schema = DRIVER_SCHEMAS["orders"]

    def add(i, days):
        rows = [(i * 100 + k, 1, "F", 10.0, dt.datetime(2000, 1, d, 12), "x") for k, d in enumerate(days)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "d" / "orders.parquet"))
        T.stream_order_counts(spark, str(tmp_path / "d"), str(tmp_path / "s"), str(tmp_path / "c"), mode="append",
                              watermark="3 days")
    add(1, [1, 2, 10])
    add(2, [8, 3, 20])       # 8 is late but inside, 3 is behind the watermark
    add(3, [30])
    got = {r.window_start.day: r.orders for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got == {1: 1, 2: 1, 8: 1, 10: 1, 20: 1}


def test_orders_added_later_are_not_lost(spark, tmp_path):
    at = copy_tables(tmp_path / "t", ("orders",))
    orders = spark.read.schema(DRIVER_SCHEMAS["orders"]).parquet(f"{SMOKE_DIR}/orders.parquet")
    orders.write.parquet(f"{at}/orders.parquet")
    before = queries()["mart_merchant_daily"](spark, at).agg(F.sum("total_orders")).first()[0]
    late = orders.limit(5).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000) \
        .withColumn("o_orderdate", F.lit(dt.datetime(2003, 5, 1)).cast("timestamp_ntz"))
    late.write.mode("append").parquet(f"{at}/orders.parquet")
    q = queries()
    assert q["mart_merchant_daily"](spark, at).agg(F.sum("total_orders")).first()[0] == before + 5
    assert q["mart_customer_rfm"](spark, at).agg(F.sum("frequency_orders")).first()[0] == before + 5
    assert q["seasonal_sales"](spark, at).agg(F.sum("orders")).first()[0] == before + 5
    assert q["dim_date"](spark, at).agg(F.max("full_date")).first()[0] == dt.date(2003, 12, 31)


def test_an_order_with_half_the_lines_keeps_unique_ids(spark, tmp_path):
    at = copy_tables(tmp_path / "t", ("lineitem",))
    li = spark.read.schema(DRIVER_SCHEMAS["lineitem"]).parquet(f"{SMOKE_DIR}/lineitem.parquet")
    li.withColumn("l_orderkey", F.when(F.col("l_partkey") % 2 == 0, 7).otherwise(F.col("l_orderkey")).cast("long")) \
        .write.parquet(f"{at}/lineitem.parquet")
    items = star_for(spark, at).d.order_items
    assert items.groupBy("order_id").count().agg(F.max("count")).first()[0] > 2000
    assert items.count() == items.select("order_item_id").distinct().count()


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(g, float(v)) for g in ("a", None) for v in range(10)], "g string, v double")
    got = {(r.g, r.v): (r.n_before, r.n_group) for r in value_ranks(df, ["g"], "v").collect()}
    assert got == {(g, float(v)): (v, 10) for g in ("a", None) for v in range(10)}
    q = {r.g: (r.n, r.m) for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert q == {"a": (10, 4.5), None: (10, 4.5)}
    split = ML.stratified_split(spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "id long, y int"),
                                "id", ["y"], 0.3)
    assert split.count() == 100
    assert {r.y: r["sum"] for r in split.groupBy("y").agg(F.sum(F.col("is_test").cast("int")).alias("sum")).collect()} == \
        {None: 3, 0: 12, 1: 15}


def test_split_is_exact_when_ids_share_a_hash(spark):
    ids = [i + j * 2 ** 32 for i in range(25) for j in range(4)]
    split = ML.stratified_split(spark.createDataFrame([(i,) for i in ids], "id long"), "id", None, 0.3)
    assert split.where("is_test").count() == 30


def test_bucket_windows_have_an_exchange_of_their_own(spark):
    """With broadcasts off, a hot group is dealt out by (group, bucket) before the window."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
                                      (F.col("id") * 7 % 1001).cast("double").alias("v"))
        r = value_ranks(df, ["g"], "v", bucket_values=100)
        r.collect()
        plan = r._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].splitlines()
        window = next(i for i, x in enumerate(plan) if "Window [" in x and "_b" in x.split("], [")[-2])
        exchange = next(x for x in plan[window:] if "Exchange" in x)
        assert "Exchange hashpartitioning(g" in exchange and "_b" in exchange
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")


def test_hot_coupon_is_reduced_before_its_join(spark):
    s = star_for(spark, SMOKE_DIR)
    plan = coupon_usage(s.d.coupons, s.d.orders)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftOuter"):]
    assert "Aggregate [coupon_id" in below


def test_threshold_is_applied_to_the_unrounded_probability(spark):
    from pyspark.ml.linalg import Vectors

    class Fixed:
        def transform(self, df):
            return spark.createDataFrame([(1, Vectors.dense([0.49997, 0.50003])), (2, Vectors.dense([0.50003, 0.49997]))],
                                         ["merchant_id", "probability"])
    empty = spark.createDataFrame([], "merchant_id long, total_gmv double, total_orders double, avg_order_value double, "
                                      "support_ticket_count double")
    got = {r.merchant_id: (r.churn_probability, r.predicted_status) for r in ML.churn_score(Fixed(), empty).collect()}
    assert got == {1: (0.5, ML.STATUS_CHURN), 2: (0.5, ML.STATUS_HEALTHY)}


def test_incremental_load_keeps_replaces_and_adds(spark, tmp_path):
    s = star_for(spark, SMOKE_DIR)
    base = str(tmp_path / "w")

    class Part:
        d, as_of = s.d, s.as_of

        def tables(self):
            t = s.tables()
            return {**t, "dw_dim_store": t["dw_dim_store"].where("store_id < 5").withColumn("store_status", F.lit("old"))
                    .union(t["dw_dim_store"].where("store_id < 2").withColumn("store_id", F.col("store_id") - 100))}
    BLD.build_warehouse(Part(), base)
    BLD.build_warehouse(s, base, incremental=True)
    got = BLD.WrittenStar(spark, base, s.as_of).dim_store
    assert got.count() == s.dim_store.count() + 2 and got.where("store_status = 'old' and store_id >= 0").count() == 0
    BLD.build_warehouse(s, base)
    assert BLD.WrittenStar(spark, base, s.as_of).dim_store.count() == s.dim_store.count()


def test_swap_leaves_one_whole_table(spark, tmp_path):
    a, b = str(tmp_path / "final"), str(tmp_path / "staging")
    for n in (3, 5):
        spark.range(n).write.parquet(b)
        S.swap(spark, b, a)
        assert spark.read.parquet(a).count() == n and not os.path.exists(b) and not os.path.exists(f"{a}__old")
    # a crash after the old table was set aside: the next swap still ends well
    shutil.move(a, f"{a}__old")
    spark.range(7).write.parquet(b)
    S.swap(spark, b, a)
    assert spark.read.parquet(a).count() == 7


def test_written_months_are_few_files(spark, tmp_path):
    df = spark.range(20_000).select("id", (F.col("id") % 12).alias("m")).repartition(16)
    S.parquet_lake_export(df, str(tmp_path / "x"), ["m"])
    files = [f for _, _, fs in os.walk(tmp_path / "x") for f in fs if f.endswith(".parquet")]
    assert len(files) <= 24


def test_no_machine_local_folder_on_a_cluster():
    class Ctx:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Ctx(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_metric_contracts_come_from_a_file(tmp_path):
    from souq.operators import semantic as L
    assert L.load_catalog(str(tmp_path / "none.yaml")) == {}
    f = tmp_path / "m.yaml"
    f.write_text("metrics:\n- {name: n, label: N, owner: o, description: d, sql_formula: COUNT(1), data_source: t, type: additive}\n")
    assert L.load_catalog(str(f))["n"].formula == "COUNT(1)"
    assert list(L.CATALOG) == ["gmv", "net_revenue", "total_orders", "average_order_value", "merchant_health_score"]


def test_models_are_fitted_once_and_scored_from_disk(spark, monkeypatch):
    s = star_for(spark, SMOKE_DIR)
    s.__dict__.pop("model_paths", None)
    calls = []
    fit = ML.train_churn
    monkeypatch.setattr(ML, "train_churn", lambda f, **kw: calls.append(1) or fit(f, num_trees=5))
    for name in ("churn_score", "merchant_risk_table", "churn_train_evaluate"):
        assert queries()[name](spark, SMOKE_DIR).count() > 0
    assert len(calls) == 1
    s.__dict__.pop("model_paths", None)
