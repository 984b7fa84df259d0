import pytest

from tabprofile.operators import categorical


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bacabcd"], "s string")
    got = [(r["value"], r["count"]) for r in categorical.top_values(df, ["s"]).orderBy("rank").collect()]
    assert got == [("a", 2), ("b", 2), ("c", 2), ("d", 1)]
    st = categorical.category_stats(df, ["s"]).first()
    assert st["unique_count"] == 4 and st["most_common"] == "a" and st["least_common"] == "d"


def _chi2_ref(table, yates):
    import numpy as np
    o = np.array(table, dtype=float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    d = np.abs(o - e)
    if yates:
        d = d - np.minimum(0.5, d)
    return float((d * d / e).sum())


def test_chi_square_2x2_yates(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 3 + [("y", "p")] * 2 + [("y", "q")] * 9
    df = spark.createDataFrame(rows, "a string, b string")
    r = categorical.chi_square(df, "a", "b").first()
    assert r["yates"] and r["dof"] == 1
    assert r["chi2"] == pytest.approx(_chi2_ref([[10, 3], [2, 9]], True))


def test_chi_square_2x2_with_absent_cell(spark):
    rows = [("x", "p")] * 5 + [("y", "p")] * 1 + [("y", "q")] * 4
    df = spark.createDataFrame(rows, "a string, b string")
    r = categorical.chi_square(df, "a", "b").first()
    assert r["chi2"] == pytest.approx(_chi2_ref([[5, 0], [1, 4]], True))


def test_chi_square_rxc_with_absent_cells(spark):
    rows = [("x", "p")] * 5 + [("y", "q")] * 4 + [("z", "r")] * 3 + [("x", "q")] * 2
    df = spark.createDataFrame(rows, "a string, b string")
    r = categorical.chi_square(df, "a", "b").first()
    assert not r["yates"] and r["dof"] == 4
    assert r["chi2"] == pytest.approx(_chi2_ref([[5, 2, 0], [0, 4, 0], [0, 0, 3]], False))


def test_distinct_count_exact(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    got = {r["column_name"]: r["distinct"] for r in categorical.distinct_count(c, ["c_name", "c_mktsegment"]).collect()}
    assert got["c_name"] == c.select("c_name").distinct().count()
    assert got["c_mktsegment"] == c.select("c_mktsegment").distinct().count()
