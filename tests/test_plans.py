import os
import tempfile

import __spark_entry__ as E
from tabprofile.plans.batch import run_batch
from tabprofile.plans.profile import profile


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "median" in df.columns


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def test_profile_sections(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    p = profile(li, "l_returnflag")
    assert set(p.sections) == {"overview", "data_quality", "statistics", "univariate", "bivariate",
                               "multivariate", "target_analysis", "insights"}
    for name, df in p.tables():
        df.limit(1).collect()
    p.release()


def test_run_batch_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="tp-batch-", dir="/tmp")
    src = os.path.join(d, "in.csv")
    with open(src, "w") as fh:
        fh.write("a,b,c,empty\n")
        for i in range(40):
            fh.write(f"{i},{i % 3},{'x' if i % 2 else 'y'},\n")
        fh.write("1,1,x,\n1,1,x,\n,,,\n")
    outs = run_batch(spark, src, os.path.join(d, "out"), target="c", train=True,
                     run_log=os.path.join(d, "runs"))
    assert "manifest" not in outs and "ml" in outs
    man = spark.read.json(os.path.join(d, "out", "manifest")).first()
    assert man["cleaned_shape"][1] == 3


def test_profile_nested_and_text_tables(spark, sf):
    from tabprofile.operators import charts
    for t, tg in [("embeddings", "label"), ("documents", "lang")]:
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        p = profile(df, tg)
        p.run_all(lambda n, d: d.write.format("noop").mode("overwrite").save())
        p.release()
        assert p.roles.roles.get("embedding", "other") == "other"
    assert "kde:n_chars" in charts.chart_data(spark.read.parquet(f"{sf}/documents.parquet"), "lang")
