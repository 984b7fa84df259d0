"""Isolation forest: paths against a plain walk, the growing rules, planted outliers first."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.operators import isolation


def table(spark, n=2000, seed=1):
    r = random.Random(seed)
    rows = [(i, r.gauss(0, 1), r.gauss(10, 3) if i % 9 else None, float(r.randrange(4)), "t") for i in range(n)]
    rows += [(n + i, 40.0 + i, -60.0, 3.0, None) for i in range(5)]
    return rows, spark.createDataFrame(rows, "id long, `a.b` double, c double, d double, text string").repartition(5)


FEATURES = ["a.b", "c", "d"]


def plain_path(nodes, row):
    """Down one tree; ``nodes`` by number."""
    at = nodes[0]
    while at["feature"] >= 0:
        v = row[at["feature"]]
        left = at["missing_left"] if v is None or v != v else v < at["split"]
        at = nodes[at["left"] if left else at["right"]]
    return at["path"]


def test_scores_are_the_plain_walk_and_outliers_come_first(spark):
    rows, df = table(spark)
    nodes = isolation.fit(df, FEATURES, trees=20, sample=64).collect()
    found = isolation.isolation_scores(df, FEATURES, trees=20, sample=64)
    assert found.columns == df.columns + ["anomaly_score"]
    got = {r["id"]: r["anomaly_score"] for r in found.collect()}
    trees = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["node"]] = n
    assert len(trees) == 20
    for row in rows[:200] + rows[-5:]:
        mean = sum(plain_path(t, row[1:4]) for t in trees.values()) / 20
        assert got[row[0]] == pytest.approx(2 ** (-mean / isolation.mean_path(64)), rel=1e-12)
    first = sorted(got, key=got.get, reverse=True)[:5]
    assert set(first) == {2000, 2001, 2002, 2003, 2004}
    again = {r["id"]: r["anomaly_score"] for r in isolation.isolation_scores(df.repartition(3), FEATURES, trees=20, sample=64).collect()}
    assert again == got  # the same whatever the partitioning


def test_trees_keep_their_rules():
    r = np.random.default_rng(4)
    x = r.normal(size=(50, 3))
    x[::7, 1] = np.nan
    x[:, 2] = 1.0  # constant: never chosen
    nodes = {n[0]: n for n in isolation.grow(x, np.random.default_rng(1), 6)}
    seen = 0

    def down(number, rows, depth, bounds):
        nonlocal seen
        _, f, split, left, right, missing_left, path = nodes[number]
        if f < 0:
            seen += len(rows)
            assert depth == 6 or len(rows) == 1 or all(len(set(x[rows, j][~np.isnan(x[rows, j])])) < 2 for j in range(3))
            assert path == depth + isolation.mean_path(len(rows)) and len(rows) > 0
            return
        v = x[rows, f]
        assert f != 2 and np.nanmin(v) < split <= np.nanmax(v)
        go = np.where(np.isnan(v), missing_left, v < split)
        assert missing_left == ((v < split).sum() >= (v >= split).sum())
        down(left, rows[go], depth + 1, bounds)
        down(right, rows[~go], depth + 1, bounds)

    down(0, np.arange(50), 0, None)
    assert seen == 50 and isolation.mean_path(2) == 1.0 and isolation.mean_path(1) == 0.0
    assert isolation.mean_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_count_above_a_share(spark):
    _, df = table(spark)
    r = isolation.isolation_outliers(df, FEATURES, contamination=0.01, trees=20, sample=64).first()
    assert r["method"] == "isolation_forest" and 1 <= r["outlier_count"] <= 21 and 0 < r["outlier_percentage"] <= 1.05
    assert isolation.isolation_outliers(df, FEATURES, threshold=0.99, trees=20, sample=64).first()["outlier_count"] == 0


def test_few_equal_missing_infinite_and_no_rows(spark):
    same = spark.createDataFrame([(1.0, 2)] * 6, "x double, y int")
    assert {r["anomaly_score"] for r in isolation.isolation_scores(same, trees=3, sample=4).collect()} == {0.5}
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (1e308,), (-1e308,)], "x double")
    got = isolation.isolation_scores(odd, trees=10, sample=8).collect()
    assert len(got) == 7 and all(0 < r["anomaly_score"] < 1 for r in got)
    one = spark.createDataFrame([(1.0,)], "x double")
    assert [r["anomaly_score"] for r in isolation.isolation_scores(one).collect()] == [0.5]
    none = spark.createDataFrame([], "x double")
    assert isolation.isolation_scores(none).collect() == []
    assert isolation.isolation_outliers(none).first()["outlier_count"] == 0
    with pytest.raises(ValueError):
        isolation.isolation_scores(spark.createDataFrame([("a",)], "x string"))
    with pytest.raises(ValueError):
        isolation.isolation_scores(one.withColumn("anomaly_score", F.lit(1)))


def test_paths_of_missing_and_infinite_values_at_every_block():
    r = np.random.default_rng(7)
    x = r.normal(size=(isolation.WALKED + 300, 3)).round(1)
    x[r.random(x.shape) < 0.2] = np.nan
    x[0], x[1] = np.inf, -np.inf
    x = np.clip(x, -isolation.LARGEST, isolation.LARGEST)
    names = [f.split()[0] for f in isolation.NODES.split(", ")]
    trees = [{n[0]: dict(zip(names, (t, *n))) for n in isolation.grow(x[r.choice(len(x), 64, False)], r, 6)} for t in range(5)]
    got = isolation.path_lengths(x, isolation._arrays([n for t in trees for n in t.values()], 3))
    for i in [*range(100), *range(isolation.WALKED - 50, len(x))]:
        assert got[i] == pytest.approx(sum(plain_path(t, x[i]) for t in trees) / 5, rel=1e-12)


def test_rows_are_scored_once(spark):
    """Rows that pass through the scoring are counted by an accumulator before it."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = 3000
    df = spark.range(n).select(F.col("id").cast("double").alias("x")).mapInArrow(counted, "x double")
    assert isolation.isolation_outliers(df, ["x"], contamination=0.5, trees=5, sample=64).first()["outlier_count"] > 0
    # the count of rows, the keys of the sample, the number of rows a tree had, and the scores
    assert seen.value <= 4 * n


def test_stored_sample_is_the_sample(spark):
    from tabprofile.operators.clean import sample_rows
    df = spark.range(20000).select((F.col("id") % 9000).alias("a.b"), (F.col("id") % 7).cast("double").alias("c"))
    for n in (1, 50, 3000, 20000, 30000):
        assert sorted(map(tuple, sample_rows(df, n, stored=True).collect())) == sorted(map(tuple, sample_rows(df, n).collect()))
