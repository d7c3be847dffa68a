"""Churn and customer-value models (M1-M8) with ``pyspark.ml``.

Training, scoring and evaluation run distributed.  Features are built with
partial aggregates; the split is exact per class (round(0.2 n) test rows of
each class, chosen by a repeatable id hash, positioned with the skew-safe
bucketed ranks), repeatable across partitionings and task retries.  Forests will not be bit-identical to other libraries: compare on
metric ranges, never per row.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import DEC_SUM, safe_ratio
from ..functions.ranks import join_groups, value_ranks
from ..session import checkpoint_dir, cut_lineage, remove_at_exit

# ---------------------------------------------------------------------------
# Features, forest sizes, weights of the synthetic target,
# scoring threshold and the texts returned with a score.
# ---------------------------------------------------------------------------
CHURN_NUMERIC = ["total_gmv", "total_orders", "avg_order_value", "support_ticket_count"]
CHURN_CATEGORICAL = "subscription_plan"
CLV_FEATURES = ["recency_days", "frequency_orders", "monetary_value"]
CHURN_THRESHOLD = 0.5
CLV_WEIGHTS = {"monetary_value": 1.2, "frequency_orders": 15.0, "recency_days": -0.5}
CHURN_FOREST = {"num_trees": 150, "max_depth": 10}
CLV_FOREST = {"num_trees": 100, "max_depth": 8}
STATUS_CHURN, STATUS_HEALTHY = "High Risk (Churn)", "Low Risk (Healthy)"
ACTION_CHURN = "Assign Dedicated Merchant Success Manager & Issue Discount Voucher"
ACTION_HEALTHY = "Merchant Healthy"

SEED = 42


# ---- M1, M5: features --------------------------------------------------------
def churn_features(d_merchant: DataFrame, d_store: DataFrame, fact_orders: DataFrame,
                   tickets: DataFrame) -> DataFrame:
    """M1: per merchant plan, status, GMV, distinct orders, mean net, tickets;
    is_churned = status 'Churned'.  Merchants without stores or orders get 0."""
    per_m = (fact_orders.select("store_id", "order_id", "gross_amount", "net_amount")
             .join(d_store.select("store_id", "merchant_id"), "store_id")
             .groupBy("merchant_id").agg(F.sum("gross_amount").alias("g"), F.countDistinct("order_id").alias("o"),
                                         F.sum("net_amount").alias("ns"), F.count("net_amount").alias("nc")))
    t = tickets.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("t"))
    m = d_merchant.select("merchant_id", "subscription_plan", "status")
    j = m.join(per_m, "merchant_id", "left").join(t, "merchant_id", "left")
    return j.select(
        "merchant_id", "subscription_plan", "status",
        F.coalesce(F.col("g"), F.lit(0)).cast(DEC_SUM).alias("total_gmv"),
        F.coalesce(F.col("o"), F.lit(0)).cast("long").alias("total_orders"),
        F.coalesce(safe_ratio(F.col("ns"), F.col("nc")), F.lit(0.0)).alias("avg_order_value"),
        F.coalesce(F.col("t"), F.lit(0)).cast("long").alias("support_ticket_count"),
        (F.col("status") == "Churned").cast("int").alias("is_churned"),
    )


def clv_features(rfm: DataFrame) -> DataFrame:
    """M5: RFM columns and the synthetic target
    max(1.2 x monetary + 15 x frequency - 0.5 x recency, 0) (a formula of the
    features, so R2 only checks the pipeline, Q16)."""
    w = CLV_WEIGHTS
    target = (F.col("monetary_value").cast("double") * w["monetary_value"]
              + F.col("frequency_orders").cast("double") * w["frequency_orders"]
              - F.col("recency_days").cast("double") * -w["recency_days"])
    return rfm.select("customer_id", "recency_days", "frequency_orders", "monetary_value",
                      F.greatest(target, F.lit(0.0)).alias("future_12m_spend"))


# ---- M3: split ------------------------------------------------------------------
HASH_MULT = 2654435761          # odd: x -> x * HASH_MULT mod 2^32 is a bijection
HASH_MOD = 4294967296


def id_hash(id_col: str, seed: int = SEED) -> Column:
    """Repeatable pseudo-random order of ids: ((id mod 2^32) x K + seed) mod 2^32.

    Exact decimal arithmetic (no overflow for any bigint id); distinct for
    distinct ids below 2^32, so ranks by it have no ties.
    """
    x = F.pmod(F.col(id_col), F.lit(HASH_MOD)).cast("decimal(20,0)")
    return F.pmod(x * F.lit(HASH_MULT) + F.lit(seed), F.lit(HASH_MOD)).cast("long")


def stratified_split(df: DataFrame, id_col: str, strata: list[str] | None = None,
                     test_fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """M3: adds ``is_test``; exactly round(fraction x n) rows of every stratum
    (the first ones in ``id_hash`` order) form the test set.

    Positions come from :func:`value_ranks`, which splits each stratum into
    value buckets, so a class holding most rows is never ranked in one task.
    Repeatable across partitionings and task retries.
    """
    strata = strata or []
    # beyond 2^32 ids can share a hash: the id's upper part orders them
    x = df.withColumn("_h", id_hash(id_col, seed).cast("decimal(20,0)") * F.lit(HASH_MOD)
                      + F.shiftright(F.col(id_col).cast("long"), 32))
    x = cut_lineage(x)  # ranked and joined back: what it is made from runs once
    r = value_ranks(x, strata, "_h").select(*strata, "_h", "n_before", "n_group")
    x = join_groups(x, r, [*strata, "_h"])
    k = F.round(F.col("n_group").cast("double") * F.lit(float(test_fraction)))
    return x.withColumn("is_test", F.col("n_before") < k).drop("_h", "n_before", "n_group")


def split_summary(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label, "is_test").agg(F.count(F.lit(1)).alias("rows"))


# ---- M2, M6: pipelines ------------------------------------------------------------
def with_balanced_weights(df: DataFrame, label: str = "is_churned") -> DataFrame:
    """class_weight='balanced': w = n / (n_classes x n_class).  The class
    counts are a two-row aggregate joined back by broadcast (bounded)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return df.join(F.broadcast(counts), label).withColumn(
        "weight", n.cast("double") / (k * F.col("_nc"))).drop("_nc")


def churn_pipeline(num_trees: int = CHURN_FOREST["num_trees"],
                   max_depth: int = CHURN_FOREST["max_depth"]) -> Pipeline:
    """M2: scale numerics (mean and std), one-hot the plan (unseen plan ->
    zero vector), random forest with balanced class weights."""
    idx = StringIndexer(inputCol=CHURN_CATEGORICAL, outputCol="plan_idx", handleInvalid="keep",
                        stringOrderType="alphabetAsc")
    # the indexer's unknown bucket is the last category; dropLast removes it,
    # so an unseen plan encodes as the all-zero vector
    ohe = OneHotEncoder(inputCols=["plan_idx"], outputCols=["plan_vec"], dropLast=True)
    num = VectorAssembler(inputCols=CHURN_NUMERIC, outputCol="num_vec")
    scaler = StandardScaler(inputCol="num_vec", outputCol="num_scaled", withMean=True, withStd=True)
    feats = VectorAssembler(inputCols=["num_scaled", "plan_vec"], outputCol="features")
    rf = RandomForestClassifier(labelCol="is_churned", featuresCol="features", weightCol="weight",
                                numTrees=num_trees, maxDepth=max_depth, seed=SEED)
    return Pipeline(stages=[idx, ohe, num, scaler, feats, rf])


def clv_pipeline(num_trees: int = CLV_FOREST["num_trees"], max_depth: int = CLV_FOREST["max_depth"]) -> Pipeline:
    """M6: scale + random forest regressor."""
    num = VectorAssembler(inputCols=CLV_FEATURES, outputCol="num_vec")
    scaler = StandardScaler(inputCol="num_vec", outputCol="features", withMean=True, withStd=True)
    rf = RandomForestRegressor(labelCol="future_12m_spend", featuresCol="features", numTrees=num_trees,
                               maxDepth=max_depth, seed=SEED)
    return Pipeline(stages=[num, scaler, rf])


def _cast_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


#: a task of a forest's training works on each of its rows for every tree and level
ROWS_PER_PARTITION = 10_000


def stable_layout(df: DataFrame, id_col: str, rows: int | None = None) -> DataFrame:
    """Hash-partition by id and sort inside partitions.

    Forest bagging draws per partition, so a layout that depends on the rows
    alone makes a refit (after an executor loss or on another day) give the
    same model no matter how the upstream plan happened to partition them.
    The number of partitions follows the row count.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(8, -(-rows // ROWS_PER_PARTITION)), id_col).sortWithinPartitions(id_col)


def churn_split(features: DataFrame) -> DataFrame:
    return stratified_split(_cast_numeric(features, CHURN_NUMERIC), "merchant_id", ["is_churned"])


def clv_split(features: DataFrame) -> DataFrame:
    return stratified_split(_cast_numeric(features, CLV_FEATURES), "customer_id")


def train_churn(features: DataFrame, **kw) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training split; returns (model, split frame)."""
    split = cut_lineage(churn_split(features))  # counted, weighted, laid out and fitted
    train = stable_layout(with_balanced_weights(split.where(~F.col("is_test"))), "merchant_id")
    return churn_pipeline(**kw).fit(train), split


def train_clv(features: DataFrame, **kw) -> tuple[PipelineModel, DataFrame]:
    split = cut_lineage(clv_split(features))
    return clv_pipeline(**kw).fit(stable_layout(split.where(~F.col("is_test")), "customer_id")), split


# ---- M4, M6: evaluation -------------------------------------------------------------
def churn_evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """M4: AUC and per-class precision / recall / F1 / support on the holdout.

    Per-class metrics are conditional counts in one aggregate over the
    scored rows (NULL when a ratio is undefined, e.g. a class absent from a
    small holdout); AUC comes from the ranking evaluator and is NULL unless
    both classes occur.
    """
    scored = model.transform(test).select(F.col("is_churned").cast("double").alias("y"), "prediction",
                                          "rawPrediction")
    y, p = F.col("y"), F.col("prediction")
    aggs = [F.countDistinct("y").alias("n_classes")]
    for c in (0, 1):
        aggs += [F.count_if((y == c) & (p == c)).alias(f"tp{c}"), F.count_if((y != c) & (p == c)).alias(f"fp{c}"),
                 F.count_if((y == c) & (p != c)).alias(f"fn{c}")]
    counts = scored.agg(*aggs).first()  # one row of counts
    auc = None
    if counts["n_classes"] == 2:
        auc = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction",
                                            metricName="areaUnderROC", numBins=0).evaluate(scored)
    rows = [("auc", None, auc)]
    for c in (0, 1):
        tp, fp, fn = counts[f"tp{c}"], counts[f"fp{c}"], counts[f"fn{c}"]
        prec = tp / (tp + fp) if tp + fp else None
        rec = tp / (tp + fn) if tp + fn else None
        f1 = 2 * prec * rec / (prec + rec) if prec and rec else (0.0 if prec is not None and rec is not None else None)
        rows += [("precision", c, prec), ("recall", c, rec), ("f1", c, f1), ("support", c, float(tp + fn))]
    return test.sparkSession.createDataFrame(rows, "metric string, class int, value double")


def clv_evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """M6: R2, RMSE and MAE on the holdout, from one pass of sums over the scored rows.

    All are NULL without rows; R2 is NULL when all targets are equal.
    """
    scored = model.transform(test).select(F.col("future_12m_spend").alias("y"), F.col("prediction").alias("p"))
    error = F.col("y") - F.col("p")
    sums = scored.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop("y").alias("spread"))
    rows = F.array(
        F.struct(F.lit("r2").alias("metric"), (1 - F.col("mse") / F.nullif("spread", F.lit(0.0))).alias("value")),
        F.struct(F.lit("rmse").alias("metric"), F.sqrt("mse").alias("value")),
        F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")))
    return sums.select(F.inline(rows))


# ---- M7, M8: persistence and scoring -----------------------------------------------------
def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_path(spark, name: str) -> str:
    """Models live in the shared checkpoint folder (cluster-visible), one folder for each application;
    it goes when the driver ends."""
    own = os.path.join(checkpoint_dir(spark), "models", spark.sparkContext.applicationId)
    remove_at_exit(spark, own)
    return os.path.join(own, uuid.uuid4().hex, name)


def clv_score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """M7: predicted spend of the next 12 months per customer."""
    s = model.transform(_cast_numeric(features, CLV_FEATURES))
    return s.select("customer_id", F.round("prediction", 2).alias("predicted_12m_spend"))


def churn_score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """M8: churn probability (4 places), status and recommended action at p > 0.5.

    The threshold is applied to the unrounded probability.
    """
    s = model.transform(_cast_numeric(features, CHURN_NUMERIC))
    p = vector_to_array("probability")[1]
    churn = p > CHURN_THRESHOLD
    return s.select(
        "merchant_id", F.round(p, 4).alias("churn_probability"),
        F.when(churn, STATUS_CHURN).otherwise(STATUS_HEALTHY).alias("predicted_status"),
        F.when(churn, ACTION_CHURN).otherwise(ACTION_HEALTHY).alias("action_recommendation"),
    )

