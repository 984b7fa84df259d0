"""Result tables: outlier rows, kinds, metrics of fixed predictions, run log, equal columns."""

import datetime as dt
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tabprofile.operators import clean, ml, quality, stats
from tabprofile.plans.profile import profile
from tabprofile.session import ensure_checkpoint_dir
from tabprofile.sources import readers, sinks


def test_outlier_rows_keep_all_columns(spark):
    df = spark.createDataFrame([(float(x), str(x)) for x in [1, 2, 3, 4, 100]] + [(None, "n"), (math.nan, "nan")], "x double, s string")
    got = stats.outlier_rows(df, "x").collect()
    assert [(r.x, r.s, r.lower_bound, r.upper_bound) for r in got] == [(100.0, "100", -1.0, 7.0)]
    assert stats.outlier_rows(df.where("x is null"), "x").count() == 0


def test_infer_kinds(spark):
    rows = [("2024-01-0%d" % (i % 9 + 1), "a" if i % 2 else "b", "t%d" % i, None, i) for i in range(10)]
    got = {r[0]: r[1] for r in readers.infer_kinds(spark.createDataFrame(rows, "d string, c string, t string, e string, n int")).collect()}
    assert got == {"d": "datetime", "c": "category", "t": "object", "e": "object", "n": "int"}


def test_equal_columns_form_groups(spark):
    rows = [(1, 1, 3, 1, None, None), (2, 2, 2, 2, None, None), (3, 3, 1, 3, None, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, permuted int, c int, e int, f int")
    assert [tuple(r) for r in quality.duplicate_columns(df).collect()] == [("a", "b"), ("a", "c"), ("e", "f")]
    assert quality.duplicate_columns(df.limit(0)).count() == 5  # no row tells them apart


def test_metrics_of_fixed_predictions(spark):
    pred = spark.createDataFrame([("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")], "label string, prediction string")
    grid = ml.confusion_matrix(pred)
    assert grid.count() == 9
    m = {r.metric: r.value for r in ml.classification_metrics(grid).collect()}
    assert m["accuracy"] == pytest.approx(5 / 7) and m["recall"] == pytest.approx(5 / 7)
    assert m["precision"] == pytest.approx((4 * 3 / 4 + 2 * 2 / 3) / 7)
    assert m["f1"] == pytest.approx((4 * 3 / 4 + 2 * 4 / 5) / 7)
    nothing = {r.metric: r.value for r in ml.classification_metrics(grid.limit(0)).collect()}
    assert nothing["accuracy"] is None
    reg = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (None, 1.0)], "label double, prediction double")
    r = {x.metric: x.value for x in ml.regression_metrics(reg).collect()}
    assert r["r2"] == pytest.approx(1 - 2 / 8) and r["rmse"] == pytest.approx(math.sqrt(2 / 3))


def test_too_few_numeric_targets(spark):
    df = spark.createDataFrame([(str(i) if i < 5 else "x%d" % i, i) for i in range(30)], "y string, x int")
    assert ml.train_baseline(df, "y", task="regression").metrics.first()["metric"] == "error"


def test_run_log_of_many_runs(spark):
    path = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    day = dt.datetime(2024, 5, 1)
    runs = spark.createDataFrame([(str(i), i % 2, day + dt.timedelta(hours=i)) for i in range(6)], "run_id string, user_id int, created_at timestamp")
    sinks.append_runs(runs, path)
    sinks.append_runs(runs.limit(0), path)
    got = sorted((r.user_id, r.rank, r.run_id, r.status) for r in sinks.latest_runs(spark, path, 2).collect())
    assert got == [(0, 1, "4", "completed"), (0, 2, "2", "completed"), (1, 1, "5", "completed"), (1, 2, "3", "completed")]


def test_json_rows_round_trip(spark):
    df = spark.createDataFrame([(1, 'a "quoted"\n line', None), (2, None, 0.5)], "i int, s string, d double")
    back = sinks.parse_json_rows(sinks.to_json_rows(df), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_profile_counts_decimals_as_they_are(spark):
    df = spark.createDataFrame([("12345678901234567890",), ("12345678901234567891",)], "s string").select(F.col("s").cast("decimal(20,0)").alias("d"))
    assert profile(df)["data_quality"]["duplicates"].first()["duplicates"] == 0


def test_preview_order_and_saved_bytes(spark):
    df = spark.createDataFrame([(3,), (1,), (None,)], "a long")
    assert [r.a for r in clean.preview(df, 2, ["a"]).collect()] == [None, 1]
    assert clean.narrowing_plan(df).first()["saved_bytes"] == 14
