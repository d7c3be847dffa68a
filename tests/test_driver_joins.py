"""What joins of stored tables send through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from souq.operators.quality import deleted_by_cascade
from souq.session import shuffled_if_many


def test_many_rows_in_small_files_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "products")
    spark.range(2000).select(F.col("id").alias("product_id"), F.lit(1).alias("cost")).write.parquet(path)
    products, items = spark.read.parquet(path), spark.range(9000).select((F.col("id") % 2000).alias("product_id"))
    plan = lambda p: items.join(p.select("product_id", "cost"), "product_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(shuffled_if_many(products))
    many = shuffled_if_many(products, most=1999)
    assert "BroadcastHashJoin" not in plan(many) and items.join(many, "product_id").count() == 9000
    # through an aggregate as well
    assert "BroadcastHashJoin" not in plan(many.groupBy("product_id").agg(F.max("cost").alias("cost")))


def test_an_erasure_sends_the_given_keys_not_the_table(spark, tmp_path):
    path = str(tmp_path / "reviews")
    spark.range(2000).select(F.col("id").alias("review_id")).write.parquet(path)
    gone = spark.createDataFrame([(5,), (5,), (7,), (None,), (99999,)], "k long")
    deleted = deleted_by_cascade({"reviews": spark.read.parquet(path)}, "reviews", gone)["reviews"]
    assert sorted(map(repr, deleted.collect())) == ["Row(review_id=5)", "Row(review_id=7)"]
    plan = deleted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("parquet") < plan.index("LogicalRDD")
