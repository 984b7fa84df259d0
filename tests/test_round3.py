"""Awkward but ordinary tables: white space and line breaks in CSV, map columns, names that clash or
hold dots, empty levels, codes that look like numbers, years that look like dates."""

import random

import pytest
from pyspark.sql import functions as F

from tabprofile.operators import charts, clean, ml, split, target
from tabprofile.plans.batch import run_batch
from tabprofile.plans.profile import profile
from tabprofile.sources import readers, sinks

TEXTS = [" a ", "b\t", "\tc", "  ", 'say "x"', "x, y", "plain", "é \\ z"]


def test_csv_keeps_white_space_at_both_ends(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    sinks.write_table(df, f"{tmp_path}/t.csv", "csv")
    back = {r["id"]: r["t"] for r in readers.load(spark, f"{tmp_path}/t.csv").collect()}
    assert back == dict(enumerate(TEXTS))


def test_csv_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, "two\nlines", "z"), (2, 'a "q" \r\n, b', "y"), (3, 'ends\n', "x")] + [(i, f"t{i}", "w") for i in range(4, 30)],
                               "id int, t string, u string")
    sinks.write_table(df, f"{tmp_path}/b.csv", "csv")
    with pytest.raises(ValueError, match="multiline"):
        readers.load(spark, f"{tmp_path}/b.csv")
    back = readers.load(spark, f"{tmp_path}/b.csv", multiline=True)
    assert dict(back.dtypes)["id"] == "bigint"
    assert {(r["id"], r["t"]) for r in back.collect()} == {(r["id"], r["t"].replace("\r\n", "\n")) for r in df.collect()} \
        or {(r["id"], r["t"]) for r in back.collect()} == {(r["id"], r["t"]) for r in df.collect()}
    with pytest.raises(ValueError, match="multiline"):
        run_batch(spark, f"{tmp_path}/b.csv", f"{tmp_path}/o1", charts_on=False)
    out = run_batch(spark, f"{tmp_path}/b.csv", f"{tmp_path}/o2", charts_on=False, reader_options={"multiline": True})
    assert spark.read.parquet(out["cleaned"]).count() == 29


@pytest.mark.parametrize("line, broken", [('1,"a', True), ('"a', True), ('1,"a""b', True), ('1,"a","b', True), ('1,5" pipe', False), ('1,"a"', False),
                                          ('1,"a""b",2', False), ('1,"a,b",5" x', False), ('', False), (',,"', True), ('x,"a",b"c', False)])
def test_lines_that_end_inside_a_field(spark, line, broken):
    odd = line.count('"') % 2 == 1
    found = spark.createDataFrame([(line,)], "value string").where(F.col("value").rlike(readers.OPEN_FIELD)).count() == 1
    assert (odd and found) == broken


CODES = [("1D", "3", None), ("2F", "2", 6.0), (" 4 ", "1e1", 40.0), ("x", "2", 0.0), (None, "7", 0.0), ("-.5", "2", -1.0), ("0x10", "1", 0.0), ("5.", "2", 10.0)]


def test_codes_are_no_numbers(spark):
    df = spark.createDataFrame([r[:2] for r in CODES], "a string, b string")
    assert sorted(r["a"] for r in clean.coerce_numeric(df, "a").collect()) == [-0.5, 4.0, 5.0]
    got = {(r["a"], r["b"]): r["p"] for r in target.derive_product(df, "a", "b", "p").collect()}
    assert got == {("1D", "3"): 0.0, ("2F", "2"): 0.0, (" 4 ", "1e1"): 40.0, ("x", "2"): 0.0, (None, "7"): 0.0, ("-.5", "2"): -1.0, ("0x10", "1"): 0.0, ("5.", "2"): 10.0}
    assert sum(r["count"] for r in charts.histogram(df, "a", coerce=True).collect()) == 3


def test_years_and_postcodes_are_no_dates(spark):
    df = spark.createDataFrame([("2020", "90210", "2020-01-05", "2021-3", "2020-01-05 10:00:00", "1999-12-31T23:59:59Z")] * 2,
                               "y string, zip string, d string, m string, ts string, iso string")
    kinds = {r["column_name"]: r["kind"] for r in readers.infer_kinds(df).collect()}
    assert kinds["y"] == kinds["zip"] == "object" and {kinds[c] for c in ("d", "m", "ts", "iso")} == {"datetime"}


CLASHES = "rn int, group_size int, __copy string, __k string, __h int, `a.b` string"


def test_split_keeps_all_columns(spark):
    rows = [(i % 7, i, "c", "k", i % 3, "AB"[i % 2]) for i in range(60)] * 2
    df = spark.createDataFrame(rows, CLASHES)
    for made, name in ((split.stratified_split(df, "a.b"), "split"), (split.random_split(df), "split"), (split.stratified_folds(df, "a.b", 3), "fold")):
        assert made.columns == df.columns + [name]
        assert sorted(tuple(r)[:-1] for r in made.collect()) == sorted(rows)
    again = df.withColumn("split", F.lit(1))
    with pytest.raises(ValueError, match="split"):
        split.stratified_split(again, "a.b")
    assert split.stratified_split(again, "a.b", name="part").columns == again.columns + ["part"]


def map_table(spark):
    return spark.sql("""select * from values (1, map('a', 1, 'b', 2), 'x'), (1, map('b', 2, 'a', 1), 'x'), (1, map('a', 1, 'b', 2), 'x'),
        (2, map('a', 1), 'y'), (2, cast(null as map<string,int>), 'y'), (3, map(), 'z'), (3, map(), 'z') as t(k, m, `s.t`)""")


def test_map_columns(spark, tmp_path):
    df = map_table(spark)
    assert clean.dedup(df).count() == 4 and clean.dedup(df).dtypes == df.dtypes
    for n in (0, 3, 7, 20):
        s = clean.sample_rows(df, n, seed=3)
        assert s.dtypes == df.dtypes and s.count() == min(n, 7)
    assert target.choose_target(df) == "k"
    nested = df.select(F.struct("m").alias("n"), F.array("m").alias("l"))
    assert clean.dedup(nested).count() in (4, 5)  # inside other types maps are compared as JSON, so in their order
    df.write.parquet(f"{tmp_path}/m.parquet")
    out = run_batch(spark, f"{tmp_path}/m.parquet", f"{tmp_path}/out", charts_on=False, max_rows=5)
    assert spark.read.parquet(out["cleaned"]).count() == 4


def test_unknown_target_is_one_error_entry(spark, sf):
    df = spark.read.parquet(f"{sf}/nation.parquet")
    p = profile(df, "no such column")
    assert [tuple(r) for r in p["target_analysis"]["error"].collect()] == [("no such column", "Target column not found")]
    assert p["overview"]["shape"].first()["rows"] == 25 and p["insights"]["insights"].count() > 0


def test_model_on_awkward_columns(spark):
    r = random.Random(2)
    rows = [(float(i), r.choice(["", "x", "y"]), None, None, r.choice(["u", "v"]), i % 5, "AB"[i % 2] if i % 11 else "A") for i in range(120)]
    df = spark.createDataFrame(rows, "`c.d` double, level string, `none.s` string, none_d double, `cat.e g` string, split int, `t.y` string")
    res = ml.train_baseline(df, "t.y", num_trees=5, max_depth=4, cv_folds=2)
    m = {x["metric"]: x["value"] for x in res.metrics.collect()}
    assert m["train_size"] + m["test_size"] == 120 and 0 <= m["roc_auc"] <= 1 and 0 <= m["cv_accuracy_mean"] <= 1
    assert m["numeric_features"] == 2 and m["categorical_features"] == 2
    names = {x["feature"] for x in res.importances.collect()}
    assert names <= {"c.d", "split", "level__oh_", "level__oh_x", "level__oh_y", "cat.e g__oh_u", "cat.e g__oh_v"} and "level__oh_" in names
    empty = df.select("`none.s`", "none_d", "`t.y`")
    assert ml.train_baseline(empty, "t.y").metrics.first()["metric"] == "error"
    reg = ml.train_baseline(df.select("level", "`c.d`"), "c.d", num_trees=3, max_depth=3)
    assert {x["metric"] for x in reg.metrics.collect()} >= {"r2", "rmse"}


def test_exact_roc_auc(spark):
    r = random.Random(7)
    rows = [(r.randrange(2), r.choice([0.1, 0.2, 0.2, r.random()])) for _ in range(500)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    table = rows + [(None, 0.5), (1, None), (0, float("nan")), (2, 0.3)]
    got = ml.roc_auc(spark.createDataFrame(table, "label int, score double").repartition(5)).first()
    assert got["roc_auc"] == pytest.approx(want, rel=1e-12) and (got["positives"], got["negatives"]) == (len(pos), len(neg))
    assert ml.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first()["roc_auc"] is None


def test_wanted_pairs_alone_give_the_same_sums(spark):
    from tabprofile.functions.moments import column_facts, gram_sums
    r = random.Random(3)
    rows = [tuple(None if r.random() < .2 else r.gauss(i, 2) for i in range(5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    cols, facts = list("abcde"), column_facts(df, list("abcde"))
    whole, some = gram_sums(df, cols, facts), gram_sums(df, cols, facts, "c")
    assert set(some) == {(x, "c") for x in "abde"}
    for (x, _), got in some.items():
        n, sa, sb, saa, sbb, sab = whole[(x, "c")] if x < "c" else [whole[("c", x)][i] for i in (0, 2, 1, 4, 3, 5)]
        assert got == pytest.approx((n, sa, sb, saa, sbb, sab), rel=1e-12)


def test_charts_are_computed_when_asked_for(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), float(i * i), float(-i), "ab"[i % 2]) for i in range(30)], "x double, y double, z double, k string")
    asked = []
    monkeypatch.setattr(charts, "kde", lambda df, c: asked.append(c))
    tables = charts.chart_data(df, "k")
    assert {"histograms", "kde:x", "corr_heatmap", "pca", "pca_lines", "target_classes"} <= set(tables) and not asked
    assert tables["kde:y"] is None and tables["kde:y"] is None and asked == ["y"]  # once


def test_scree_lines(spark):
    from tabprofile.operators.multivariate import scree_lines
    t = spark.createDataFrame([(1, .7, .7), (2, .15, .85), (3, .1, .95), (4, .05, 1.0)], "component int, explained_variance_ratio double, cumulative_variance double")
    assert sorted(tuple(r) for r in scree_lines(t).collect()) == [(0.8, 2, 0.85), (0.95, 3, 0.95)]
    assert scree_lines(t.limit(0)).collect() == []
