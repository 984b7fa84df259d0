import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.operators import charts, clean, split


def test_histogram_matches_numpy(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("value")
    got = [r["count"] for r in charts.histogram(ev, "value").orderBy("bin").collect()]
    ref, _ = np.histogram(ev.toPandas()["value"].to_numpy(), bins=30)
    assert got == list(ref)
    assert sum(got) == ev.count()


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "x double")
    h = charts.histogram(df, "x").orderBy("bin").collect()
    ref, edges = np.histogram([2.0] * 3, bins=30)
    assert [r["count"] for r in h] == list(ref)
    assert h[0]["bin_start"] == pytest.approx(edges[0]) and h[-1]["bin_end"] == pytest.approx(edges[-1])


def test_kde_matches_direct_sum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 2, 300)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = charts.kde(df, "x").orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** (-0.2)
    grid = np.linspace(x.min(), x.max(), 100)
    ref = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r["density"] for r in got] == pytest.approx(list(ref), rel=1e-9)


def test_sample_rows_partition_independent(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    a = [r[0] for r in clean.sample_rows(o.repartition(1), 50).collect()]
    b = [r[0] for r in clean.sample_rows(o.repartition(7), 50).collect()]
    assert a == b and len(set(a)) == 50


def test_cap_columns_target_last(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, t int, d int")
    assert clean.cap_columns(df, 3, "t").columns == ["a", "b", "t"]
    assert clean.cap_columns(df, 3).columns == ["a", "b", "t"]


def test_narrowing(spark):
    df = spark.createDataFrame([(1, 70000, 0.5, 1234567.891)], "a long, b long, c double, d double")
    plan = {r["column_name"]: r["to_type"] for r in clean.narrowing_plan(df).collect()}
    assert plan == {"a": "tinyint", "b": "int", "c": "float", "d": "double"}


def test_stratified_split_quotas_and_partitioning(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    a = split.stratified_split(o.repartition(3), "o_orderstatus")
    b = split.stratified_split(o.repartition(5), "o_orderstatus")
    ta = sorted(r[0] for r in a.where("split = 'test'").select("o_orderkey").collect())
    tb = sorted(r[0] for r in b.where("split = 'test'").select("o_orderkey").collect())
    assert ta == tb
    per = {r["o_orderstatus"]: (r["n"], r["t"]) for r in
           a.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    for n, t in per.values():
        assert t == math.ceil(0.2 * n)


def test_rank_within_skewed_group(spark):
    # one group holds most rows; ranks must be 0..n-1 per group
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(17)]
    df = spark.createDataFrame(rows, "g string, v long")
    keyed = df.withColumn("k", F.md5(F.col("v").cast("string")))
    r = split.rank_within(keyed, ["g"], "k").collect()
    import hashlib
    for g, n in (("hot", 3000), ("cold", 17)):
        order = sorted(range(n), key=lambda v: hashlib.md5(str(v).encode()).hexdigest())
        assert {x["v"]: (x["rn"], x["group_size"]) for x in r if x["g"] == g} == {v: (i, n) for i, v in enumerate(order)}


def test_split_of_whole_rows_is_exact(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        rows = split.stratified_split(o, "o_orderstatus").collect()
        folds = split.stratified_folds(o, "o_orderstatus", 5).collect()
        spark.conf.unset("spark.sql.exchange.reuse")
        for c in {r["o_orderstatus"] for r in rows}:
            mine = [r["split"] for r in rows if r["o_orderstatus"] == c]
            assert mine.count("test") == math.ceil(0.2 * len(mine))
            sizes = [sum(r["fold"] == k for r in folds if r["o_orderstatus"] == c) for k in range(5)]
            assert sum(sizes) == len(mine) and max(sizes) - min(sizes) <= 1


def test_sample_of_repeated_rows_is_uniform(spark):
    df = spark.range(20000).select((F.col("id") % 20).alias("v"))
    got = [r["v"] for r in clean.sample_rows(df, 2000).collect()]
    counts = [got.count(v) for v in range(20)]
    assert len(got) == 2000 and min(counts) > 60 and max(counts) < 140
    assert sorted(got) == sorted(r["v"] for r in clean.sample_rows(df.repartition(7), 2000).collect())
    assert clean.sample_rows(df, 10**6).count() == 20000
    test = split.random_split(df).where("split = 'test'").groupBy("v").count().collect()
    assert len(test) == 20 and all(120 < r["count"] < 280 for r in test)


def test_cleaning_keeps_types_and_digits(spark):
    from decimal import Decimal
    a, b = Decimal("12345678901234567890"), Decimal("12345678901234567891")
    df = spark.createDataFrame([(a, 1.5), (b, 1.5), (a, 1.5), (None, float("nan"))], "d decimal(20,0), f float")
    out = clean.dedup(clean.drop_empty_rows(df))
    assert out.schema == df.schema and {r["d"] for r in out.collect()} == {a, b} and out.count() == 2
    from tabprofile.operators import quality
    assert quality.duplicates(df).first()["duplicates"] == 1


def test_impute_integers_with_gaps(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 2, None), (None, None, None), (3, 5, None)], "a int, b long, c int")
    out = clean.impute(df)
    assert dict(out.dtypes)["a"] == "int" and [r["a"] for r in out.collect()] == [1, 2, 2, 3]
    out = clean.impute(df.where("a is null or a < 3"))
    assert dict(out.dtypes)["a"] == "double" and [r["a"] for r in out.collect()] == [1, 2, 1.5]


def test_histograms_as_numpy(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    for c in ("l_discount", "l_tax", "l_extendedprice", "l_quantity"):
        want, _ = np.histogram([r[0] for r in li.select(c).collect()], bins=30)
        assert [r["count"] for r in charts.histogram(li, c).orderBy("bin").collect()] == want.tolist()


def test_folds_balanced(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    f = split.stratified_folds(o, "o_orderstatus", 5)
    for r in f.groupBy("o_orderstatus").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).collect():
        assert r["a"] >= 0 and r["b"] <= 4


def test_fill_and_impute(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b"), (10.0, None)], "x double, s string")
    f = {r["column_name"]: r["fill_value"] for r in clean.fill_values(df).collect()}
    assert float(f["x"]) == 3.0 and f["s"] == "b"
    out = clean.impute(df).collect()
    assert out[1]["x"] == 3.0 and out[3]["s"] == "b"


def test_kde_binned_close_to_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    a = [r["density"] for r in charts.kde(df, "x").orderBy("point").collect()]
    b = [r["density"] for r in charts.kde(df, "x", bins=4096).orderBy("point").collect()]
    assert max(abs(p - q) for p, q in zip(a, b)) < 1e-3 * max(a)
