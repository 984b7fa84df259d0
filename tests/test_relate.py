import numpy as np
import pandas as pd
import pytest

from tabprofile.operators import multivariate, relate


def test_corr_pairwise_complete_and_constant(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 6.5, 5.0), (4.0, 8.0, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["feature1"], r["feature2"]): r["correlation"] for r in relate.correlation_pairs(df).collect()}
    pdf = pd.DataFrame(rows, columns=list("abc"))
    assert got[("a", "b")] == pytest.approx(pdf.corr().loc["a", "b"])
    assert got[("a", "c")] is None and got[("b", "c")] is None
    assert relate.avg_correlation(relate.correlation_pairs(df)).first()[0] is None


def test_anova_matches_hand_computation(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [4.0, 6.0], "c": [10.0, 11.0, 12.0, 9.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "t string, x double")
    r = relate.anova(df, "t", ["x"]).first()
    allv = np.concatenate([np.array(v) for v in groups.values()])
    grand = allv.mean()
    ssb = sum(len(v) * (np.mean(v) - grand) ** 2 for v in groups.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    f = (ssb / 2) / (ssw / (len(allv) - 3))
    assert r["groups"] == 3 and r["f_stat"] == pytest.approx(f)


def test_anova_single_group_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "t string, x double")
    assert relate.anova(df, "t", ["x"]).first()["f_stat"] == 0.0


def test_feature_importance_needs_numeric_target(spark):
    df = spark.createDataFrame([("a", 1.0)], "t string, x double")
    with pytest.raises(ValueError):
        relate.feature_importance(df, "t")


def test_pca_matches_numpy(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    got = [r["explained_variance_ratio"] for r in multivariate.pca_variance(li).orderBy("component").collect()]
    x = li.toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    assert got == pytest.approx(list(ev / ev.sum()), abs=1e-9)
    assert sum(got) == pytest.approx(1.0)
    cum = multivariate.pca_variance(li).orderBy("component").collect()[-1]["cumulative_variance"]
    assert cum == pytest.approx(1.0)


def test_pca_constant_column_adds_zero(spark):
    rows = [(float(i), float(i * i % 7), 3.0) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r["explained_variance_ratio"] for r in multivariate.pca_variance(df).orderBy("component").collect()]
    assert len(got) == 3 and got[-1] == pytest.approx(0.0, abs=1e-12)


def test_pca_from_pairs_equals_direct(spark, sf):
    from tabprofile.functions.moments import column_facts
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cols = li.columns
    facts = column_facts(li, cols)
    pairs = relate.correlation_pairs(li, cols, facts)
    a = [r[1] for r in multivariate.pca(li, cols, pairs, facts)[0].orderBy("component").collect()]
    b = [r[1] for r in multivariate.pca(li, cols)[0].orderBy("component").collect()]
    assert a == pytest.approx(b, abs=1e-12)


def test_correlations_equal_pandas(spark, sf):
    from tabprofile.functions.moments import column_facts, pair_correlations
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    from pyspark.sql import functions as F
    d = li.select("l_quantity", "l_extendedprice", "l_tax",
                  F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"),
                  F.when(F.col("l_orderkey") % 7 != 0, F.col("l_partkey")).alias("gappy"),
                  F.lit(2.0).alias("const"))
    cols = d.columns
    facts = column_facts(d, cols)
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    want = d.toPandas().astype(float).corr()
    got = pair_correlations(d.repartition(3), pairs, facts)
    for a, b in pairs:
        if "const" in (a, b):
            assert got[a, b] is None
        else:
            assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-12), (a, b)
    far = spark.createDataFrame([(1.0, 2.0), (float("inf"), 1.0), (3.0, 4.0)], "x double, y double")
    assert pair_correlations(far, [("x", "y")], column_facts(far, ["x", "y"])) == {("x", "y"): None}
