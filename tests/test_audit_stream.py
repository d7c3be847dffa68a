"""Running audit state over micro-batches, and results that a micro-batch rewrites."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from souq.operators import quality as G
from souq.queries import star_for
from souq.sources import sinks as S
from souq.sources.adapter import order_money
from souq.sources.driver import DRIVER_SCHEMAS
from souq.streaming import streams as T

from .conftest import SMOKE_DIR

AS_OF = dt.date(2001, 8, 2)


def test_running_state_equals_the_batch_audits(spark, tmp_path):
    orders = spark.read.schema(DRIVER_SCHEMAS["orders"]).parquet(f"{SMOKE_DIR}/orders.parquet")
    src = tmp_path / "src" / "orders.parquet"
    # the first files hold no order that fails an audit
    bad = (F.col("o_orderkey") % 101 == 0) | (F.col("o_orderkey") % 97 == 0)
    clean = orders.where(~bad).where("o_orderdate < '2001-01-01'").limit(300)
    clean.coalesce(1).write.parquet(str(src))
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    first = {r.check_name: r for r in T.stream_audit_state(spark, str(tmp_path / "src"), sink, ck, AS_OF).collect()}
    assert [r.checked_records for r in first.values()] == [300, 300] and all(r.status == "PASS" for r in first.values())
    rest = orders.join(clean.select("o_orderkey"), "o_orderkey", "left_anti").select(orders.columns)
    late = rest.limit(2).withColumn("o_orderdate", F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz"))
    rest.repartition(4).write.mode("append").parquet(str(src))
    late.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000).coalesce(1).write.mode("append").parquet(str(src))
    # a restart with small micro-batches goes on from the stored state
    state = {r.check_name: r for r in T.stream_audit_state(spark, str(tmp_path / "src"), sink, ck, AS_OF, max_files=1).collect()}
    everything = orders.union(late.withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))
    batch = order_money(everything).withColumn("order_date", F.col("o_orderdate").cast("timestamp"))
    want = {r.check_name: r for r in G.dq_financial_reconciliation(batch).union(G.dq_boundary(batch, AS_OF)).collect()}
    n = everything.count()
    for name, w in want.items():
        assert (state[name].checked_records, state[name].failed_records, state[name].passed, state[name].status) == \
            (n, w.failed_records, w.passed, w.status)
    assert state[G.CHECK_BOUNDARY].failed_records == 2 and state[G.CHECK_BOUNDARY].first_failed_order >= 10_000_000
    # drained again: no new epoch, nothing counted twice
    again = {r.check_name: r for r in T.stream_audit_state(spark, str(tmp_path / "src"), sink, ck, AS_OF).collect()}
    assert again == state
    trail = T.audit_trail(spark, sink)
    for name in want:
        mine = trail.where(F.col("check_name") == name).orderBy("epoch").collect()
        assert len(mine) >= 5 and sum(r.new_records for r in mine) == n
        assert sum(r.new_failures for r in mine) == want[name].failed_records
        assert [r.status for r in mine][0] == "PASS" and sum(r.changed for r in mine) == 1


def test_a_reader_never_misses_the_result_of_complete_mode(spark, tmp_path):
    sink = str(tmp_path / "sink")
    with pytest.raises(FileNotFoundError):
        T.read_last_epoch(spark, sink)
    T.write_epoch(spark.range(3), sink, 0, keep=2)
    T.write_epoch(spark.range(4), sink, 1, keep=2)
    assert T.read_last_epoch(spark, sink).count() == 4
    # an epoch that a crash left without its mark is not read; its retry replaces it
    spark.range(9).write.parquet(f"{sink}/epoch=2")
    os.remove(f"{sink}/epoch=2/_SUCCESS")
    assert T.read_last_epoch(spark, sink).count() == 4
    T.write_epoch(spark.range(5), sink, 2, keep=2)
    assert T.read_last_epoch(spark, sink).count() == 5
    assert sorted(n for n in os.listdir(sink) if n.startswith("epoch")) == ["epoch=1", "epoch=2"]
    T.write_epoch(spark.range(6), sink, 10, keep=2)
    assert T.read_last_epoch(spark, sink).count() == 6 and sorted(os.listdir(sink)) == ["epoch=10", "epoch=2"]


def test_complete_mode_keeps_epochs_apart(spark):
    s = star_for(spark, SMOKE_DIR)
    sink = S.work_path(spark, "tests", "epochs")
    out = T.stream_order_counts(spark, SMOKE_DIR, sink, S.work_path(spark, "tests", "ck"))
    assert out.agg(F.sum("orders")).first()[0] == s.d.raw("orders").count()
    assert all(n.startswith("epoch=") for n in os.listdir(sink))
