import os
import tempfile

import pytest
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import functions as F

from tabprofile.operators import ml, target
from tabprofile.sources import readers, sinks


def test_csv_na_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="tp-csv-", dir="/tmp")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as fh:
        fh.write("num,text,flag,when\n1.5,NA,true,2020-01-01\n,abc,false,2020-01-02\n3,None,,2020-01-03\n")
    df = readers.load(spark, p)
    types = dict(df.dtypes)
    assert types == {"num": "double", "text": "string", "flag": "boolean", "when": "string"}
    rows = df.collect()
    assert rows[0]["text"] is None and rows[1]["num"] is None and rows[2]["flag"] is None


def test_unsupported_format(spark):
    with pytest.raises(ValueError):
        readers.load(spark, "/tmp/x.xyz")


def test_run_log_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tp-runs-", dir="/tmp")
    path = os.path.join(d, "runs")
    a = sinks.log_run(spark, path, "orders", user_id=1, target_column="o_orderstatus", accuracy=0.5)
    b = sinks.log_run(spark, path, "lineitem", user_id=1)
    assert sinks.read_run(spark, path, a).first()["dataset_name"] == "orders"
    assert [r["run_id"] for r in sinks.history(spark, path, 1).collect()][0] == b


def test_unseen_category_is_zero_vector(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("z",)], "c string")
    si = StringIndexer(inputCol="c", outputCol="i", handleInvalid="keep").fit(train)
    oh = OneHotEncoder(inputCol="i", outputCol="v", dropLast=True).fit(si.transform(train))
    v = oh.transform(si.transform(test)).first()["v"]
    assert v.numNonzeros() == 0 and v.size == 2


def test_target_resolution(spark):
    df = spark.createDataFrame([("2", "3.5", "x")], "`Quantity Ordered` string, `Price Each` string, Other string")
    d, col = target.resolve_target(df, " sales ")
    assert col == "Sales" and d.first()["Sales"] == pytest.approx(7.0)
    d2, col2 = target.resolve_target(df, "OTHER")
    assert col2 == "Other"


def test_choose_target(spark):
    df = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(50)], "id int, name string, grp int")
    assert target.choose_target(df, None, train=True) == "grp"
    assert target.choose_target(df.withColumnRenamed("grp", "Label"), None) == "Label"


def test_baseline_classifier_metrics(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    res = ml.train_baseline(o, "o_orderstatus", num_trees=5, max_depth=4)
    m = {r["metric"]: r["value"] for r in res.metrics.collect()}
    assert res.task == "classification"
    for k in ("accuracy", "precision", "recall", "f1"):
        assert 0.0 <= m[k] <= 1.0
    assert m["train_size"] + m["test_size"] == o.count()
    assert res.confusion.agg(F.sum("count")).first()[0] == m["test_size"]


def test_baseline_guards(spark):
    df = spark.createDataFrame([(1.0, "a")] * 5, "x double, y string")
    res = ml.train_baseline(df, "y")
    assert res.metrics.first()["metric"] == "error"


def test_forest_rows_are_spread_by_what_it_keeps(spark, monkeypatch):
    """Rows that lie in one partition train the forest in many; a small table stays as it is."""
    from pyspark.ml.classification import RandomForestClassifier
    seen = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, d: (seen.append((d.rdd.getNumPartitions(), d.count())), fit(self, d))[1])
    df = spark.range(4000).select((F.col("id") % 50).cast("double").alias("x"), F.concat(F.lit("l"), F.col("id") % 5).alias("k"),
                                  F.when(F.col("id") % 50 < 25, "a").otherwise("b").alias("y")).coalesce(1)
    small = ml.train_baseline(df, "y", num_trees=5, max_depth=3)
    assert ml._forest_parts(4000, 6, 5) == 1 and ml._forest_parts(7_200_000, 6, 100) > 100 and ml._forest_parts(720_000, 2400, 8) > 100
    monkeypatch.setattr(ml, "TASK_BYTES", 100_000)
    spread = ml.train_baseline(df, "y", num_trees=5, max_depth=3)
    assert seen[0][1] == seen[1][1] == 3200 and seen[0][0] < 5 and seen[1][0] == ml._forest_parts(3200, 6, 5) >= 8
    for r in (small, spread):
        found = {m["metric"]: m["value"] for m in r.metrics.collect()}
        assert found["train_size"] == 3200 and found["final_feature_count"] == 6 and found["accuracy"] == 1.0 and found["roc_auc"] == 1.0
