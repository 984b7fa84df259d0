import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from tabprofile.operators import forest, ml


def table(spark, classes, n=3000, seed=3):
    """Few values a column, so that MLlib's bins are all of them; labels depend on columns and chance."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x, z, c, d = rng.randrange(12), rng.randrange(30) / 4, rng.choice("abcdefg"), rng.choice("uvw")
        s = x * (2 if c in "ace" else 1) + 3 * (d == "v") + z + rng.random() * 6
        rows.append((float(x), z, c, d, float(int(s)) if classes is None else f"y{int(s) * classes // 40 % classes}"))
    return spark.createDataFrame(rows, f"x double, z double, c string, d string, label_ {'double' if classes is None else 'string'}")


def prepared(spark, classes, **kw):
    df = table(spark, classes, **kw)
    stages = []
    if classes is None:
        df = df.withColumnRenamed("label_", "label")
    else:
        df = StringIndexer(inputCol="label_", outputCol="label", stringOrderType="alphabetAsc").fit(df).transform(df)
        weights = spark.createDataFrame([(float(i), 1.0 + i / 2) for i in range(classes)], "label double, weight double")
        df = df.join(weights, "label")
    for c in "cd":
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCol=f"{c}__idx", outputCol=f"{c}__oh", dropLast=True)]
    stages.append(VectorAssembler(inputCols=["x", "c__oh", "z", "d__oh"], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df).transform(df).cache(), stages


def estimator(classes, **kw):
    kw = {"maxDepth": 5, "seed": 42, "numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all"} | kw
    return RandomForestRegressor(labelCol="label", **kw) if classes is None else \
        RandomForestClassifier(labelCol="label", weightCol="weight", **kw)


def says(model, ready, classes):
    want = ["prediction"] if classes is None else ["prediction", "probability"]
    rows = model.transform(ready).select("x", "z", "c", "d", *want).distinct().collect()
    return {(r["x"], r["z"], r["c"], r["d"]): [r["prediction"], *(r["probability"] if classes else [])] for r in rows}


@pytest.mark.parametrize("classes", [None, 2, 3])
@pytest.mark.parametrize("cells", [True, False])
def test_a_tree_of_all_rows_is_mllibs(spark, monkeypatch, classes, cells):
    ready, stages = prepared(spark, classes)
    if not cells:
        monkeypatch.setattr(forest, "CELL_BYTES", 0)
        monkeypatch.setattr(forest, "CHUNK_ROWS", 500)
        monkeypatch.setattr(forest, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(forest, "GROUP_BYTES", 40_000)  # several passes a level
        monkeypatch.setattr(forest, "LOOKUP", 100)
    theirs = estimator(classes).fit(ready)
    ours = forest.grown(ready, stages, estimator(classes), ready.count())
    assert (ours.totalNumNodes, ours.trees[0].depth, ours.numFeatures) == (theirs.totalNumNodes, theirs.trees[0].depth, theirs.numFeatures)
    assert ours.totalNumNodes > 25
    if classes == 3:  # two classes and regressions may name the sides of a level the other way round
        assert ours.trees[0].toDebugString.split("\n")[1:] == theirs.trees[0].toDebugString.split("\n")[1:]
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), rel=1e-9)
    a, b = says(ours, ready, classes), says(theirs, ready, classes)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12)
    assert ours.getMaxDepth() == 5 and ours.getOrDefault("maxBins") == 32 and ours.getNumTrees == 1


@pytest.mark.parametrize("classes", [None, 3])
def test_cells_and_rows_grow_the_same_forest(spark, monkeypatch, classes):
    """Features are drawn anew for every node, whether rows stay apart or are summed."""
    ready, stages = prepared(spark, classes)
    e = estimator(classes, numTrees=4, featureSubsetStrategy="sqrt")
    a = forest.grown(ready, stages, e, ready.count())
    monkeypatch.setattr(forest, "CELL_BYTES", 0)
    b = forest.grown(ready, stages, e, ready.count())
    assert [t.toDebugString.split("\n")[1:] for t in a.trees] == [t.toDebugString.split("\n")[1:] for t in b.trees]
    assert len({t.toDebugString.split("\n", 1)[1] for t in a.trees}) == 4


@pytest.mark.parametrize("classes", [None, 3])
@pytest.mark.parametrize("cells", [True, False])
def test_bootstrapped_forests_are_as_good_as_mllibs(spark, monkeypatch, classes, cells):
    ready, stages = prepared(spark, classes, n=2000)
    fresh, _ = prepared(spark, classes, n=2000, seed=4)
    if not cells:
        monkeypatch.setattr(forest, "CELL_BYTES", 0)
    e = estimator(classes, numTrees=20, bootstrap=True, featureSubsetStrategy="all" if classes is None else "sqrt")
    found = []
    for model in (forest.grown(ready, stages, e, 2000), e.fit(ready)):
        rows = model.transform(fresh).select("label", "prediction").collect()
        found.append(np.mean([(r["label"] - r["prediction"]) ** 2 if classes is None else r["label"] == r["prediction"] for r in rows]))
        found.append(model.featureImportances.toArray())
    assert found[0] == pytest.approx(found[2], rel=0.05)
    assert np.abs(found[1] - found[3]).max() < 0.08


def test_bootstrap_counts_are_poisson(spark, monkeypatch):
    kept = []
    real = forest.shared_table
    monkeypatch.setattr(forest, "shared_table", lambda df, name: kept.append(real(df, name)) or kept[-1])
    monkeypatch.setattr(forest, "CELL_BYTES", 0)
    ready, stages = prepared(spark, 3, n=2000)
    forest.grown(ready, stages, estimator(3, numTrees=10, maxDepth=2, bootstrap=True), 2000)
    rows = [np.frombuffer(r["drawn"], np.uint8) for r in kept[0].collect()]
    drawn = np.array(rows)
    assert drawn.shape == (2000, 10) and kept[0].columns == ["k0", "k1", "k2", "k3", "y", "drawn"]
    shares = np.bincount(drawn.ravel(), minlength=4)[:4] / drawn.size
    assert shares == pytest.approx([math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6], abs=0.015)
    assert np.abs(np.corrcoef(drawn.T) - np.eye(10)).max() < 0.12


def test_thresholds_of_all_rows(spark):
    rows = [(float(i), 7.0 if i % 10 else float(i), float(i % 3), 5.0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    cuts = forest._thresholds(df, list("abcd"), 32)
    assert list(cuts["c"]) == [0.5, 1.5] and len(cuts["d"]) == 0
    sizes = np.bincount(np.searchsorted(cuts["a"], np.arange(20_000)))
    assert len(sizes) == 32 and sizes.max() <= 632  # 625 and a few of 10,000 ranks
    b = np.array([r[1] for r in rows])
    at = np.searchsorted(cuts["b"], b)
    assert len(cuts["b"]) >= 29 and len(set(at[b == 7.0])) == 1 and set(b[at == at[1]]) == {7.0}
    assert np.bincount(at[b != 7.0]).max() <= 2000 / 28


def test_regression_rows_are_summed_by_cells(spark, monkeypatch):
    """A hundred trees don't meet each row at every level: a task keeps one row for each combination of bins."""
    kept = []
    real = forest.shared_table
    monkeypatch.setattr(forest, "shared_table", lambda df, name: kept.append(real(df, name)) or kept[-1])
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, d: pytest.fail("MLlib's fit meets each row again"))
    monkeypatch.setattr(ml, "GROWN_BYTES", 1000)
    rows = [("ab"[i % 2], "uvw"[i % 3], float(i % 10), float(i % 10 * (1 + i % 2) + i % 7)) for i in range(8000)]
    df = spark.createDataFrame(rows, "a string, b string, c double, y double")
    res = ml.train_baseline(df, "y", num_trees=100, max_depth=4, task="regression")
    m = {r["metric"]: r["value"] for r in res.metrics.collect()}
    assert m["n_estimators"] == 100 and m["final_feature_count"] == 6 and m["train_size"] + m["test_size"] == 8000
    stored = kept[0].collect()
    assert len(stored) <= 60 * spark.sparkContext.defaultParallelism
    sums = np.array([np.frombuffer(r["drawn"]).reshape(100, 3) for r in stored]).sum(0)
    assert np.abs(sums[:, 0] - m["train_size"]).max() < 5 * m["train_size"] ** 0.5
    noise = np.var(np.arange(7)) / np.var([r[3] for r in rows])
    assert 1 - noise - 0.1 < m["r2"] < 1 - noise + 0.05


def test_wide_models_are_grown_over_bin_numbers(spark, monkeypatch):
    """Past ``GROWN_BYTES`` no row is expanded: MLlib's fit isn't called."""
    for kind in (RandomForestClassifier, RandomForestRegressor):
        monkeypatch.setattr(kind, "fit", lambda self, d: pytest.fail("MLlib's fit keeps a number for each feature"))
    monkeypatch.setattr(ml, "GROWN_BYTES", 1000)
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        day, x = rng.randrange(30), rng.random()
        rows.append((f"d{day}", x, None if i % 9 == 0 else float(i % 7), f"y{x > 0.5}", float(day % 2) + x))
    df = spark.createDataFrame(rows, "`the.day` string, x double, split double, y string, v double")
    res = ml.train_baseline(df.drop("v"), "y", num_trees=8, max_depth=5)
    m = {r["metric"]: r["value"] for r in res.metrics.collect()}
    assert m["train_size"] + m["test_size"] == 1500 and m["final_feature_count"] == 32 and m["max_bins"] == 32
    assert m["accuracy"] > 0.7 and res.importances.first()["feature"] == "x"
    assert res.confusion.agg({"count": "sum"}).first()[0] == m["test_size"]
    res = ml.train_baseline(df.drop("y", "the.day"), "v", num_trees=8, max_depth=5, task="regression")
    m = {r["metric"]: r["value"] for r in res.metrics.collect()}
    assert m["final_feature_count"] == 2 and 0.1 < m["r2"] < 0.5
