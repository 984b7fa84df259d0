import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprofile.operators import quantiles, stats


def _close(a, b, tol=1e-9):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and abs(a - b) <= tol * max(1.0, abs(b))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_small_n_moments_match_pandas(spark, n):
    vals = [float(i) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = stats.numeric_moments(df).first()
    s = pd.Series(vals)
    assert _close(r["std"], s.std())
    assert _close(r["skewness"], s.skew())
    assert _close(r["kurtosis"], s.kurtosis())


def test_constant_column_moments(spark):
    df = spark.createDataFrame([(5.0,)] * 6, "x double")
    r = stats.numeric_moments(df).first()
    assert r["skewness"] == 0.0 and r["kurtosis"] == 0.0 and r["std"] == 0.0


def test_random_moments_match_pandas(spark):
    rng = np.random.default_rng(1)
    vals = rng.gamma(2.0, 3.0, 500)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = stats.numeric_moments(df).first()
    s = pd.Series(vals)
    assert _close(r["skewness"], s.skew(), 1e-9)
    assert _close(r["kurtosis"], s.kurtosis(), 1e-9)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    r = stats.describe(df).first()
    assert r["count"] == 1 and r["mean"] == 1.0


def test_describe_matches_pandas(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = {r["column_name"]: r for r in stats.describe(li).collect()}
    pdf = li.select("l_quantity", "l_extendedprice").toPandas()
    for c in ["l_quantity", "l_extendedprice"]:
        d = pdf[c].describe()
        for k, pk in [("mean", "mean"), ("std", "std"), ("q25", "25%"), ("median", "50%"), ("q75", "75%")]:
            assert _close(got[c][k], d[pk], 1e-9), (c, k)


def test_bracketed_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(0, 1, 3000), np.full(1500, 0.25), rng.integers(0, 5, 1000).astype(float)])
    b = rng.exponential(2.0, a.size)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    # force the bracket-refinement path with a tiny direct limit
    got = quantiles.quantiles(df, ["a", "b"], probs, direct_limit=200, buckets=8).collect()
    for r in got:
        ref = np.percentile(a if r["column_name"] == "a" else b, r["prob"] * 100)
        assert _close(r["value"], float(ref), 1e-12), (r, ref)


def test_quantiles_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    rows = quantiles.quantiles(df, ["x"], [0.5], direct_limit=0).collect()
    assert rows[0]["value"] is None


def test_iqr_outliers_and_values(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, -50.0, 3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = stats.iqr_outliers(df).first()
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert r["outlier_count"] == int(((s < lo) | (s > hi)).sum())
    ov = [x["value"] for x in stats.outlier_values(df).orderBy("rank").collect()]
    assert ov == [100.0, -50.0]


def test_unknown_outlier_method_raises(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        stats.iqr_outliers(df, method="isolation_forest")


def test_estimated_bytes(spark):
    df = spark.createDataFrame([(1, "ab"), (None, "héllo")], "a long, s string")
    got = {r["column_name"]: r["bytes"] for r in stats.estimated_bytes(df).collect()}
    assert got == {"a": 8, "s": 2 + len("héllo".encode())}


def test_quantiles_mixed_paths_and_packing(spark):
    rng = np.random.default_rng(11)
    big = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([(float(b), float(i % 7), float(i % 5)) for i, b in enumerate(big)],
                               "big double, s1 double, s2 double")
    # limit 4000: s1 + s2 (6000 values) must split into two exact aggregates; big (3000) fits alone
    got = {(r["column_name"], r["prob"]): r["value"]
           for r in quantiles.quantiles(df, ["big", "s1", "s2"], [0.3, 0.5], direct_limit=4000).collect()}
    pdf = df.toPandas()
    for c in ["big", "s1", "s2"]:
        for p in [0.3, 0.5]:
            assert _close(got[(c, p)], float(np.percentile(pdf[c], p * 100)), 1e-12)
    # limit 1000: every column takes the bracket path
    got2 = {(r["column_name"], r["prob"]): r["value"]
            for r in quantiles.quantiles(df, ["big", "s1"], [0.3], direct_limit=1000, buckets=4).collect()}
    assert _close(got2[("big", 0.3)], float(np.percentile(big, 30)), 1e-12)
    assert _close(got2[("s1", 0.3)], float(np.percentile(pdf["s1"], 30)), 1e-12)


def test_bracketed_quantiles_with_infinities(spark):
    rng = np.random.default_rng(3)
    inf = float("inf")
    vals = [-inf] * 40 + [inf] * 25 + list(rng.normal(0, 1, 900)) + [2.5] * 300
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.02, 0.0405, 0.1, 0.5, 0.9, 0.98, 1.0]
    got = {r["prob"]: r["value"] for r in quantiles.quantiles(df, ["x"], probs, direct_limit=50, buckets=8).collect()}
    srt = sorted(vals)
    for p in probs:
        h = (len(srt) - 1) * p
        a, b = srt[int(np.floor(h))], srt[int(np.ceil(h))]
        want = a if a == b else a + (h - np.floor(h)) * (b - a)
        assert got[p] == want or _close(got[p], want, 1e-12), (p, got[p], want)


def test_infinite_and_huge_values(spark):
    """Infinities leave the mean alone, spread and shape are NULL; 1e80 is in range."""
    from tabprofile.operators import charts, clean
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 1e80), (2.0, 2e80), (3.0, 3e80), (4.0, 9e80), (inf, 4e80)], "x double, y double")
    r = {x["column_name"]: x for x in stats.numeric_moments(df).collect()}
    assert r["x"]["mean"] == inf and r["x"]["std"] is None and r["x"]["skewness"] is None and r["x"]["kurtosis"] is None
    s = pd.Series([1.0, 2.0, 3.0, 9.0, 4.0])
    assert _close(r["y"]["std"] / 1e80, s.std()) and _close(r["y"]["skewness"], s.skew()) and _close(r["y"]["kurtosis"], s.kurtosis())
    z = {x["column_name"]: x["outlier_count"] for x in stats.zscore_outliers(df, threshold=1.5).collect()}
    assert z == {"x": 0, "y": 1}
    assert {x["x"] for x in clean.standardize(df, ["x"]).collect()} == {None}
    k = charts.kde(df, "x", points=5).collect()
    assert len(k) == 5 and all(0 < x["density"] < 1 for x in k)
