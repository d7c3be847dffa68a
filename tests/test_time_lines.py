"""Running sums, point-in-time lookup and inventory movement against plain Python."""

import datetime as dt
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from souq.functions.prefix import running_sum
from souq.operators import inventory as IV
from souq.operators import pointintime as PT

T0 = dt.datetime(2024, 1, 1)


def test_running_sum_of_a_hot_entity_and_null_keys(spark):
    g = random.Random(2)
    rows = [(g.choice(["hot", "hot", "a", None]), g.randrange(30), i, g.choice([None, -3, 1, 4])) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, day int, id int, v int").repartition(5)
    got = {(r.k, r.id): r.s for r in running_sum(df, ["k"], F.col("day"), ["day", "id"], "v", "s").collect()}
    for k in ("hot", "a", None):
        total = 0
        for _, day, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            total += v or 0
            assert got[k, i] == total


def test_rows_of_an_entity_are_dealt_out_by_bucket(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "-1")
        df = spark.range(5000).select(F.lit("hot").alias("k"), (F.col("id") % 90).alias("day"), "id")
        out = running_sum(df, ["k"], F.col("day"), ["day", "id"], "id", "s")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].splitlines()
        inside = next(i for i, x in enumerate(plan) if "Window [" in x and "_bucket" in x.split("], [")[-2])
        exchange = next(x for x in plan[inside:] if "Exchange hashpartitioning" in x)
        assert "_bucket" in exchange
        join = next(i for i, x in enumerate(plan) if "SortMergeJoin" in x)
        assert join < inside and not any("Exchange hashpartitioning(k" in x and "_bucket" not in x for x in plan[join:inside])
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)


def test_lookup_sees_only_what_was_known(spark):
    g = random.Random(7)
    feats = [(g.choice(["a", "hot", "hot", "hot", None]), T0 + dt.timedelta(days=g.randrange(200), hours=g.choice([0, 0, 5])), g.randrange(100))
             for _ in range(400)] + [("late", None, 5), ("a", None, 9)]
    labels = [(i, g.choice(["a", "hot", "hot", None, "unknown", "late"]),
               T0 + dt.timedelta(days=g.randrange(-20, 230), hours=g.choice([0, 5, 6])) if g.random() > 0.05 else None) for i in range(600)]
    labels += labels[:3]  # repeated labels stay
    f = spark.createDataFrame(feats, "e string, known timestamp, x int")
    q = spark.createDataFrame(labels, "id int, e string, t timestamp").repartition(4)
    for age in (None, 10):
        out = PT.lookup(q, f, ["e"], "t", "known", ["x"], max_age=f"{age} days" if age else None).collect()
        assert len(out) == len(labels)
        for r in out:
            known = [(k, x) for e, k, x in feats if e == r.e and k is not None and r.t is not None and k <= r.t]
            best = max(known, default=(None, None))  # the latest; of one moment the greatest
            if age and best[0] is not None and best[0] < r.t - dt.timedelta(days=age):
                best = (None, None)
            assert (r.feature_time, r.x) == best, r
    assert PT.lookup(q.limit(0), f, ["e"], "t", "known", ["x"]).count() == 0
    assert PT.lookup(q, f.limit(0), ["e"], "t", "known", ["x"]).where("x is not null").count() == 0


SALES = "order_item_id long, order_id long, product_id long, date_id int, quantity int, gross_sales decimal(10,2)"
RETURNS = "return_id long, order_id long, product_id long, return_status string, refund_amount decimal(10,2), requested_at timestamp"
STOCK = "inventory_id long, product_id long, stock_quantity int, reorder_level int"


def test_inventory_movement(spark):
    sales = spark.createDataFrame([
        (1, 1, 7, 20240101, 5, D("50.00")), (2, 1, 7, 20240101, 1, D("10.00")), (3, 2, 7, 20240110, 4, D("40.00")),
        (4, 3, 8, 20240105, 2, D("0.00")), (5, 4, 9, 20240105, 2, D("3.00")), (6, 5, 99, 20240105, 2, D("3.00"))], SALES)
    returns = spark.createDataFrame([
        (1, 1, 7, "Approved", D("20.00"), T0 + dt.timedelta(days=9)), (2, 1, 7, "Rejected", D("10.00"), T0),
        (3, 2, 7, "Refunded", D("14.99"), T0 + dt.timedelta(days=20)), (4, 3, 8, "Approved", D("0.00"), T0),
        (5, 77, 7, "Approved", D("10.00"), T0), (6, 4, 9, "Requested", D("3.00"), T0)], RETURNS)
    stock = spark.createDataFrame([(1, 7, 99, 1), (2, 7, 3, 2), (3, 8, 0, 0), (4, 9, 1, 5), (5, 10, 4, 4)], STOCK)
    ledger = [tuple(r) for r in IV.inventory_ledger(stock, sales, returns).orderBy("product_id", "moved_on", "kind", "ref_id").collect()]
    day = lambda n: dt.date(2024, 1, n)
    assert ledger == [
        (7, day(1), "sale", 1, -5, 5), (7, day(1), "sale", 2, -1, 4),
        (7, day(10), "return", 1, 2, 6), (7, day(10), "sale", 3, -4, 2), (7, day(21), "return", 3, 1, 3),
        (8, day(1), "return", 4, 0, 2), (8, day(5), "sale", 4, -2, 0), (9, day(5), "sale", 5, -2, 1)]
    got = {r.product_id: tuple(r)[1:] for r in IV.inventory_movement(stock, sales, returns).collect()}
    assert got == {7: (10, 10, 3, 3, 2, day(10), day(10), 0), 8: (2, 2, 0, 0, 0, day(5), day(5), 0),
                   9: (3, 2, 0, 1, 1, day(5), day(5), 0), 10: (4, 0, 0, 4, 4, None, None, 0)}
    assert IV.inventory_movement(stock, sales.limit(0), returns.limit(0)).count() == 4
