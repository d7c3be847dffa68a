"""Skew-safe ranks and exact quantiles against brute force on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from souq.functions.quantiles import exact_quantiles
from souq.functions.ranks import _split, skew_safe_rank, value_ranks


def skewed_frame(seed: int, n: int = 3000) -> pd.DataFrame:
    """One hot group with a third of the rows; many ties; a few NULLs."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    v = np.round(rng.gamma(2.0, 50.0, n), 2)
    v[rng.random(n) < 0.2] = 100.0          # a heavy tie
    pdf = pd.DataFrame({"g": g.astype("int64"), "v": v, "id": np.arange(n, dtype="int64")})
    pdf.loc[pdf.sample(frac=0.01, random_state=seed).index, "v"] = np.nan
    return pdf


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("bucket_values", [1, 100, 100_000])
def test_rank_matches_pandas(spark, seed, descending, bucket_values):
    pdf = skewed_frame(seed)
    df = spark.createDataFrame(pdf.astype({"v": "float64"})).withColumn(
        "v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = skew_safe_rank(df, ["g"], "v", descending=descending, bucket_values=bucket_values).toPandas().set_index("id")["rank"]
    want = pdf.groupby("g")["v"].rank(method="min", ascending=not descending)
    both = pd.concat([got.rename("got"), want.rename("want")], axis=1)
    assert both["got"].isna().equals(both["want"].isna())
    m = both.dropna()
    assert (m["got"].astype(int) == m["want"].astype(int)).all()


@pytest.mark.parametrize("seed", [4, 5])
def test_quantiles_match_numpy(spark, seed):
    pdf = skewed_frame(seed).dropna()
    df = spark.createDataFrame(pdf)
    qs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    got = exact_quantiles(df, ["g"], "v", qs).toPandas().set_index("g").sort_index()
    for g, part in pdf.groupby("g"):
        for k, q in qs.items():
            assert got.loc[g, k] == pytest.approx(np.quantile(part["v"].to_numpy(), q, method="linear"), rel=1e-12)
        assert got.loc[g, "n"] == len(part)
    glob = exact_quantiles(df, [], "v", {"median": 0.5}).first()
    assert glob["median"] == pytest.approx(np.median(pdf["v"]), rel=1e-12)


def test_value_ranks_counts(spark):
    pdf = skewed_frame(7).dropna()
    r = value_ranks(spark.createDataFrame(pdf), ["g"], "v", bucket_values=50).toPandas()
    assert r.groupby("g")["n_equal"].sum().to_dict() == pdf.groupby("g").size().to_dict()
    # positions tile 0..n-1 without gaps inside every group
    for g, part in r.groupby("g"):
        part = part.sort_values("v")
        assert (part["n_before"].to_numpy() == np.concatenate([[0], np.cumsum(part["n_equal"])[:-1]])).all()


def parts(spark, rows, bucket_values):
    """Number of parts of each group and the largest part's number of values."""
    hist = spark.createDataFrame(rows, "g string, _v double, _c long")
    out = _split(hist, ["g"], bucket_values).groupBy("g", "_b").agg(F.count(F.lit(1)).alias("n")).groupBy("g") \
        .agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("most")).collect()
    return {r.g: (r.parts, r.most) for r in out}


def test_small_groups_are_one_bucket_whatever_the_others_hold(spark):
    rows = [("hot", float(i), 1) for i in range(3000)] + [(f"small{j}", float(i), 1) for j in range(30) for i in range(4)]
    got = parts(spark, rows, 100)
    assert all(got[f"small{j}"] == (1, 4) for j in range(30))
    assert 30 <= got["hot"][0] <= 256 and got["hot"][1] <= 100


def test_a_part_that_is_still_too_large_is_split_again(spark):
    # nearly all values lie close together, far from a few others
    rows = [("hot", 1e9 + i, 1) for i in range(5)] + [("hot", i / 1e6, 1) for i in range(6000)] + [("x", 1.0, 7)]
    got = parts(spark, rows, 5)
    assert got["x"] == (1, 1) and got["hot"][0] > 256 and got["hot"][1] <= 30


def test_values_that_a_sketch_cannot_tell_apart_end_the_splitting(spark):
    rows = spark.createDataFrame([("a", 2 ** 60 + i) for i in range(50)], "g string, v long")  # one double for all
    r = {x.v: x.n_before for x in value_ranks(rows, ["g"], "v", bucket_values=3).collect()}
    assert r == {2 ** 60 + i: i for i in range(50)}
