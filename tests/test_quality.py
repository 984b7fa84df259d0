import pytest

from tabprofile.operators import clean, quality


def test_duplicates_with_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("nan"),), (1.0,)], "x double")
    assert quality.duplicates(df).first()["duplicates"] == 2


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = {r["column_name"]: r["missing"] for r in quality.missing(df).collect()}
    assert got == {"x": 2, "s": 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert quality.quality_score(df).first()["quality_score"] == 100.0
    assert clean.drop_empty_columns(df).columns == []


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b")], "k int, e double, s string")
    assert sorted(r[0] for r in quality.constant_columns(df).collect()) == ["e", "k"]


def test_quality_score_formula(spark):
    # 4 rows, one duplicate pair, column b half missing
    df = spark.createDataFrame([(1, None), (1, None), (2, 5), (3, 6)], "a int, b int")
    r = quality.quality_score(df).first()
    assert r["avg_missing_pct"] == pytest.approx(25.0)
    assert r["duplicate_pct"] == pytest.approx(25.0)
    assert r["quality_score"] == 0.0  # 100 - 2*25 - 5*25 < 0, clipped


def test_missing_patterns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, 3)], "a int, b int")
    got = {r["pattern"]: r["rows"] for r in quality.missing_patterns(df).collect()}
    assert got == {"01": 1, "11": 1, "00": 1}


def test_duplicate_columns(spark):
    df = spark.createDataFrame([(1, 1, 2), (None, None, 3)], "a int, b int, c int")
    assert [tuple(r) for r in quality.duplicate_columns(df).collect()] == [("a", "b")]
