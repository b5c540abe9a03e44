"""Boosted trees and feature choice on tables with missing values."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketloom.functions.numeric import correlation
from marketloom.operators import boosting as bo


def test_corr_feature_filter_pairs(spark):
    """Every row misses some feature and one feature is null throughout; pairs are still compared whole."""
    rnd = np.random.RandomState(2)
    n = 600
    x = rnd.randn(n, 4)
    x[:, 3] = 3 * x[:, 0] + 1e6 + 0.01 * rnd.randn(n)
    gone = rnd.rand(n, 4) < 0.3
    gone[np.arange(n), rnd.randint(0, 4, n)] = True
    names = ["a", "b", "c", "like_a"]
    rows = [(*[None if g else float(v) for v, g in zip(r, m)], None) for r, m in zip(x, gone)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "empty"])).repartition(5)
    got = bo.pairwise_correlation(df, [*names, "empty"])
    for i in range(4):
        for j in range(4):
            both = ~gone[:, i] & ~gone[:, j]
            assert abs(got[i, j] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    assert np.isnan(got[4]).all()
    table = spark.createDataFrame([("a", 0.5), ("like_a", 0.4), ("b", 0.3), ("empty", 0.2), ("c", 0.1)], "feature string, importance double")
    assert {r.feature for r in bo.corr_feature_filter(df, table).collect()} == {"a", "b", "c", "empty"}


def test_correlation_without_spread_is_null(spark):
    rnd = np.random.RandomState(3)
    pdf = pd.DataFrame({"x": rnd.randn(200), "flat": 0.1, "y": rnd.randn(200)})
    pdf["gaps"] = pdf.x.where(rnd.rand(200) < 0.7)
    df = spark.createDataFrame(pdf).repartition(4).withColumn("one", F.when(F.rand(1) < 0, 1.0))
    got = df.agg(*[correlation(c, "y").alias(c) for c in ("x", "gaps", "flat", "one")]).first()
    assert got["flat"] is None and got["one"] is None
    assert abs(got["x"] - pdf.x.corr(pdf.y)) < 1e-12 and abs(got["gaps"] - pdf.gaps.corr(pdf.y)) < 1e-12
