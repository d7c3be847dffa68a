"""The saved forests, scored from their files in plain Python: every merchant, customer and metric."""

import math
import os

import pyarrow.parquet as pq
import pytest

from souq.operators import dashboard as B
from souq.operators import ml as ML
from souq.operators import registrations as R
from souq.queries import queries, star_for

DIR = "/root/testdata/sf0.01"


def stage(path, name):
    """The data table of a saved pipeline's stage."""
    at = os.path.join(path.removeprefix("file:"), "stages")
    folder = next(d for d in os.listdir(at) if name in d)
    return pq.read_table(os.path.join(at, folder, "data")).to_pylist()


def forest(path, name):
    """tree number -> node number -> node"""
    trees = {}
    for r in stage(path, name):
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    return trees


def leaf(tree, x):
    node = tree[0]
    while node["leftChild"] >= 0:
        at, left = node["split"], node["split"]["leftCategoriesOrThreshold"]
        v = x[at["featureIndex"]]
        goes_left = v <= left[0] if at["numCategories"] == -1 else v in left  # one-hot columns are categories 0 and 1
        node = tree[node["leftChild"] if goes_left else node["rightChild"]]
    return node


def scaled(path, values):
    s = stage(path, "StandardScaler")[0]
    return [(v - m) / sd if sd else 0.0 for v, m, sd in zip(values, s["mean"]["values"], s["std"]["values"])]


def churn_probability(path, trees, row):
    plans = stage(path, "StringIndexer")[0]["labelsArray"][0]
    one_hot = [float(row["subscription_plan"] == p) for p in plans]
    x = scaled(path, [float(row[c]) for c in ML.CHURN_NUMERIC]) + one_hot
    total = 0.0
    for t in trees.values():
        stats = leaf(t, x)["impurityStats"]
        total += stats[1] / sum(stats)
    return total / len(trees)


@pytest.fixture(scope="module")
def star(spark):
    return star_for(spark, DIR)


@pytest.fixture(scope="module")
def churn(spark, star):
    """merchant -> independently computed probability"""
    path = R._stored_model(star, "merchant_churn", lambda: ML.train_churn(R._churn_features(star)))
    trees = forest(path, "RandomForest")
    assert len(trees) == ML.CHURN_FOREST["num_trees"]
    rows = [r.asDict() for r in R._churn_features(star).collect()]
    return {r["merchant_id"]: churn_probability(path, trees, r) for r in rows}



def test_every_merchant_has_its_forests_score(spark, star, churn):
    got = {r.merchant_id: r for r in queries()["churn_score"](spark, DIR).collect()}
    assert set(got) == set(churn)
    for m, p in churn.items():
        assert got[m].churn_probability == pytest.approx(p, abs=5.1e-5)
        sure = abs(p - ML.CHURN_THRESHOLD) > 1e-9
        if sure:
            assert got[m].predicted_status == (ML.STATUS_CHURN if p > 0.5 else ML.STATUS_HEALTHY)
        assert got[m].action_recommendation == (ML.ACTION_CHURN if got[m].predicted_status == ML.STATUS_CHURN else ML.ACTION_HEALTHY)


def test_risk_table_filter_and_counts_follow_from_the_scores(spark, star, churn):
    table = {r.merchant_id: r for r in queries()["merchant_risk_table"](spark, DIR).collect()}
    health = {r.merchant_id: r.health_score for r in queries()["merchant_health_by_merchant"](spark, DIR).collect()}
    growth = {r.merchant_id: r.gmv_growth for r in queries()["gmv_trajectory"](spark, DIR).collect()}
    names = {r.merchant_id: r.merchant_name for r in star.dim_merchant.collect()}
    assert set(table) == set(churn)
    count = {}
    for m, p in churn.items():
        r, p4 = table[m], table[m].churn_probability
        assert p4 == pytest.approx(p, abs=5.1e-5)
        risk = B.RISK_HIGH if p4 > 0.6 else B.RISK_MODERATE if p4 > 0.3 else B.RISK_HEALTHY
        assert (r.merchant_name, r.health_score, r.gmv_growth, r.risk_status) == (names[m], health.get(m), growth.get(m), risk)
        assert r.recommended_intervention == B.INTERVENTIONS[risk]
        count[risk] = count.get(risk, 0) + 1
    assert {r.risk_status: r.merchants for r in queries()["risk_level_counts"](spark, DIR).collect()} == count
    kept = {r.merchant_id for r in queries()["merchant_risk_filtered"](spark, DIR).collect()}
    assert kept == {m for m, r in table.items() if r.risk_status == B.RISK_HEALTHY and r.health_score is not None and r.health_score >= 90.0}


def test_churn_metrics_follow_from_the_scores(spark, star, churn):
    test = {r.merchant_id: r.is_churned for r in ML.churn_split(R._churn_features(star)).where("is_test").collect()}
    got = {(r.metric, r["class"]): r.value for r in queries()["churn_train_evaluate"](spark, DIR).collect()}
    pairs = [(churn[a], churn[b]) for a, ya in test.items() for b, yb in test.items() if ya == 1 and yb == 0]
    auc = sum(1.0 if p > q + 1e-12 else 0.5 if abs(p - q) <= 1e-12 else 0.0 for p, q in pairs) / len(pairs)
    assert got["auc", None] == pytest.approx(auc, abs=1e-6)
    for c in (0, 1):
        hit = {m: int(churn[m] > 0.5) == c for m in test}
        tp = sum(hit[m] and test[m] == c for m in test)
        said, real = sum(hit.values()), sum(y == c for y in test.values())
        assert got["support", c] == real
        assert got["precision", c] == (pytest.approx(tp / said) if said else None)
        assert got["recall", c] == (pytest.approx(tp / real) if real else None)


def test_every_customer_has_its_forests_prediction(spark, star):
    path = R._stored_model(star, "customer_clv", lambda: ML.train_clv(R._clv_features(star)))
    trees = forest(path, "RandomForest")
    assert len(trees) == ML.CLV_FOREST["num_trees"]
    rows = [r.asDict() for r in R._clv_features(star).collect()]
    want = {r["customer_id"]: sum(leaf(t, x)["prediction"] for t in trees.values()) / len(trees)
            for r in rows for x in [scaled(path, [float(r[c]) for c in ML.CLV_FEATURES])]}
    got = {r.customer_id: r.predicted_12m_spend for r in queries()["model_save_load"](spark, DIR).collect()}
    assert set(got) == set(want)
    assert all(got[c] == pytest.approx(p, abs=0.0051) for c, p in want.items())
    target = {r["customer_id"]: r["future_12m_spend"] for r in rows}
    test = [r.customer_id for r in ML.clv_split(R._clv_features(star)).where("is_test").collect()]
    err = [target[c] - want[c] for c in test]
    mean = sum(target[c] for c in test) / len(test)
    metrics = {r.metric: r.value for r in queries()["clv_train_evaluate"](spark, DIR).collect()}
    assert metrics["rmse"] == pytest.approx(math.sqrt(sum(e * e for e in err) / len(err)), rel=1e-9)
    assert metrics["mae"] == pytest.approx(sum(map(abs, err)) / len(err), rel=1e-9)
    assert metrics["r2"] == pytest.approx(1 - sum(e * e for e in err) / sum((target[c] - mean) ** 2 for c in test), rel=1e-9)


def test_metrics_of_an_empty_or_constant_holdout(spark, star):
    path = R._stored_model(star, "customer_clv", lambda: ML.train_clv(R._clv_features(star)))
    features = ML.clv_split(R._clv_features(star))
    none = {r.metric: r.value for r in ML.clv_evaluate(ML.load_model(path), features.limit(0)).collect()}
    assert none == {"r2": None, "rmse": None, "mae": None}
    one = {r.metric: r.value for r in ML.clv_evaluate(ML.load_model(path), features.limit(1)).collect()}
    assert one["r2"] is None and one["rmse"] == pytest.approx(one["mae"])
