import random

from pyspark.sql import functions as F

from tabprofile.operators import ranks


def _table(spark, n=400):
    r = random.Random(3)
    rows = [(i, r.choice([None, "a", "a", "a", "b"]), r.choice([None, 1.0, 2.0, 2.0, r.random()])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, `my.group` string, r double").repartition(5)


def test_positions_count_rows_of_each_group(spark):
    rows, df = _table(spark)
    got = ranks.positions(df, [F.col("r"), F.col("id")], ["my.group"]).collect()
    by = {}
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[2] is not None, x[2] or 0.0, x[0])):
        by.setdefault(row[1], []).append(row[0])
    want = {i: k for ids in by.values() for k, i in enumerate(ids)}
    assert {r["id"]: r["position"] for r in got} == want


def test_equal_rows_all_get_a_place(spark):
    df = spark.range(1000).select(F.lit("x").alias("k")).repartition(7)
    got = sorted(r["position"] for r in ranks.positions(df, [F.col("k")], ["k"]).collect())
    assert got == list(range(1000))


def test_running_totals(spark):
    rows, df = _table(spark)
    got = {r["id"]: (r["s"], r["n"]) for r in ranks.running(df, [F.col("id")], {"s": F.col("id"), "n": F.lit(1)}).collect()}
    assert got == {i: (i * (i - 1) // 2, i) for i in range(len(rows))}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert ranks.positions(df, [F.col("v")], ["k"]).collect() == []
    assert ranks.running(df, [F.col("v")], {"s": F.col("v")}).collect() == []
