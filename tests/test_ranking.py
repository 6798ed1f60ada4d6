"""The split ranking against brute force, including hot groups and heavy ties."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import ranking as rk


def rows(n=3000, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 3 else f"g{i % 7}"  # most rows share one key
        v = r.choice([0.5, 0.5, r.gauss(0, 1), r.gauss(0, 1e-6), -0.0, float(r.randrange(-3, 3))])
        out.append((i, g, None if r.random() < 0.05 else v))
    return out


@pytest.fixture(scope="module")
def pdf():
    return pd.DataFrame(rows(), columns=["i", "g", "v"])


def test_pct_rank_matches_pandas(spark, pdf):
    df = spark.createDataFrame(rows(), "i int, g string, v double")
    got = rk.pct_rank(df, ["g"], "v", "r").toPandas().sort_values("i")["r"].to_numpy()
    want = pdf.groupby("g")["v"].rank(pct=True, method="average").to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_long_ranks_match_single(spark, pdf):
    df = spark.createDataFrame(rows(), "i int, g string, v double").withColumn("w", F.col("v") * -2)
    got = rk.pct_ranks(df, ["i"], ["g"], {"v": "rv", "w": "rw"}, descending=("w",), fill=0.5).toPandas().sort_values("i")
    want = pdf.groupby("g")["v"].rank(pct=True).fillna(0.5).to_numpy()
    np.testing.assert_allclose(got["rv"], want, rtol=1e-12)
    np.testing.assert_allclose(got["rw"], want, rtol=1e-12)


def test_quantiles_match_numpy(spark, pdf):
    df = spark.createDataFrame(rows(), "i int, g string, v double")
    got = rk.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.97}).toPandas().set_index("g")
    for g, part in pdf.dropna().groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(part["v"], [0.1, 0.5, 0.97]), rtol=1e-12)


def test_global_group(spark, pdf):
    df = spark.createDataFrame(rows(), "i int, g string, v double")
    assert rk.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(pdf["v"].median())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=2, max_size=60))
def test_bucket_keeps_order(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", rk.order_bucket("v").alias("b")).orderBy("v").collect()
    codes = [r["b"] for r in got]
    assert codes == sorted(codes)


def test_first_rows_limits_before_shuffle(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = rk.first_rows(df, ["g"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
