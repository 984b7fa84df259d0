"""Registered queries over whole runs (profile, batch, charts), model results and the
operators' less common forms, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprofile.operators import ml, multivariate, relate, stats
from tabprofile.operators import target as target_mod
from tabprofile.plans.registry import (DIRTY_LI_SQL, LI_NUM, _anova_sql, _doc_labels, _ft_sql, _pairs_sql, _scratch, _union_sql,
                                       dirty_li, query, read, rounded, with_view)
from tabprofile.sources import readers


def _long(df, name, key, value):
    return df.select(F.lit(name).alias("name"), key.cast("string").alias("key"), F.round(value.cast("double"), 4).alias("value"))


def _stack(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- D-b, D-d, C1, B4, B6, P14
@query("q_outlier_rows", """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l.*, round(q1 - 0.3 * (q3 - q1), 4) AS lower_bound, round(q3 + 0.3 * (q3 - q1), 4) AS upper_bound FROM lineitem l, b
WHERE l_extendedprice < q1 - 0.3 * (q3 - q1) OR l_extendedprice > q3 + 0.3 * (q3 - q1)""")
def q_outlier_rows(spark, sf_dir):
    return rounded(stats.outlier_rows(read(spark, sf_dir, "lineitem"), "l_extendedprice", 0.3), 4, ["lower_bound", "upper_bound"])


@query("q_type_kinds", _union_sql([f"""SELECT '{c}' AS column_name, CASE WHEN count({e}) = 0 THEN 'object'
  WHEN count(TRY_CAST({e} AS TIMESTAMP)) = count({e}) THEN 'datetime' WHEN count(DISTINCT {e}) / count(*) < 0.5 THEN 'category' ELSE 'object' END AS kind FROM events"""
                                  for c, e in {"event_type": "event_type", "props": "props", "day": "strftime(ts, '%Y-%m-%d')",
                                               "key": "md5(CAST(event_id AS VARCHAR))"}.items()]) + " UNION ALL SELECT 'value', 'double'")
def q_type_kinds(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return readers.infer_kinds(e.select("event_type", "props", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                                        F.md5(F.col("event_id").cast("string")).alias("key"), "value"))


@query("q_dtype_shares", """SELECT CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  ELSE lower(data_type) END AS data_type, count(*) AS n_columns, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share
FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""")
def q_dtype_shares(spark, sf_dir):
    from tabprofile.operators.charts import dtype_shares
    return rounded(dtype_shares(read(spark, sf_dir, "lineitem")), 6)


GAPPY = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"]


@query("q_anova_gappy", with_view(DIRTY_LI_SQL, _anova_sql("d", "l_returnflag", GAPPY)))
def q_anova_gappy(spark, sf_dir):
    """Gaps in the classes and in two features."""
    return rounded(relate.anova(dirty_li(spark, sf_dir), "l_returnflag", GAPPY), 4)


@query("q_feature_target", f"""SELECT feature, 'numerical_vs_categorical' AS kind, NULL AS correlation, NULL AS strength, f_stat
FROM ({_anova_sql("lineitem", "l_returnflag", LI_NUM)}) a
UNION ALL SELECT feature, 'numerical_vs_numerical', round(correlation, 4) + 0.0, strength, NULL
FROM ({_ft_sql("lineitem", "l_extendedprice", [c for c in LI_NUM if c != "l_extendedprice"])}) c""")
def q_feature_target(spark, sf_dir):
    """Both branches: a class target and a numeric one."""
    li = read(spark, sf_dir, "lineitem")
    return rounded(_stack([relate.feature_target(li, "l_returnflag"), rounded(relate.feature_target(li, "l_extendedprice"), 6)]), 4)


@query("q_target_sales", """SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS Sales, l_tax AS profit FROM lineitem""")
def q_target_sales(spark, sf_dir):
    """A sales target derived from its parts, a profit target found by its alias."""
    li = read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": "Quantity Ordered", "l_extendedprice": "Price Each", "l_tax": "Net Amount"})
    li, sales = target_mod.resolve_target(li, " sales ")
    li, profit = target_mod.resolve_target(li, "Profit")
    return li.select("l_orderkey", "l_linenumber", F.round(F.col(sales), 4).alias("Sales"), F.col(profit).alias("profit"))


# ---------------------------------------------------------------- X1: the spectrum by its power sums
def _spectrum_sql(cols):
    k = len(cols)
    return f"""WITH p AS ({_pairs_sql("lineitem", cols, 14)}), m AS (SELECT i, j, correlation AS r FROM p UNION ALL SELECT j, i, correlation FROM p
  UNION ALL SELECT range, range, 1.0 FROM range({k}))
SELECT {k} AS components, CAST(1 AS DOUBLE) AS total, (SELECT round(sum(r * r) / {k ** 2}, 6) FROM m) AS squares,
  (SELECT round(sum(a.r * b.r * c.r) / {k ** 3}, 6) FROM m a JOIN m b ON a.j = b.i JOIN m c ON b.j = c.i AND c.j = a.i) AS cubes,
  (SELECT count(*) FROM lineitem) AS complete_rows"""


@query("q_pca_spectrum", _spectrum_sql(LI_NUM))
def q_pca_spectrum(spark, sf_dir):
    """Eigenvalue shares through their sums, sums of squares and of cubes, which are traces
    of powers of the correlation matrix."""
    variance, summary = multivariate.pca(read(spark, sf_dir, "lineitem"))
    v = F.col("explained_variance_ratio")
    n = summary.first()["complete_rows"]
    return variance.agg(F.count(v).alias("components"), F.round(F.sum(v), 6).alias("total"), F.round(F.sum(v * v), 6).alias("squares"),
                        F.round(F.sum(v * v * v), 6).alias("cubes"), F.lit(n).alias("complete_rows"))


# ---------------------------------------------------------------- M8, M9, M13: metrics of fixed predictions
GUESS_SQL = """SELECT l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 20 THEN 'A' ELSE 'X' END AS prediction
FROM lineitem WHERE l_returnflag IS NOT NULL"""


def _guesses(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where("l_returnflag IS NOT NULL")
    return li.select(F.col("l_returnflag").alias("label"), F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 20, "A")
                     .otherwise("X").alias("prediction"))


@query("q_confusion_grid", with_view(GUESS_SQL, """, l AS (SELECT label AS v FROM d UNION SELECT prediction FROM d)
SELECT a.v AS label, b.v AS prediction, CAST((SELECT count(*) FROM d WHERE d.label = a.v AND d.prediction = b.v) AS BIGINT) AS count
FROM l a, l b""").replace(")\n,", "),"))
def q_confusion_grid(spark, sf_dir):
    """All cells, those without rows too."""
    return ml.confusion_matrix(_guesses(spark, sf_dir))


@query("q_class_metrics", with_view(GUESS_SQL, """, l AS (SELECT label AS v FROM d UNION SELECT prediction FROM d),
c AS (SELECT v, (SELECT count(*) FROM d WHERE label = v) AS a, (SELECT count(*) FROM d WHERE prediction = v) AS p,
  (SELECT count(*) FROM d WHERE label = v AND prediction = v) AS h FROM l),
s AS (SELECT *, CASE WHEN p > 0 THEN h / p ELSE 0.0 END AS pr, CASE WHEN a > 0 THEN h / a ELSE 0.0 END AS re FROM c)
SELECT 'accuracy' AS metric, round(sum(h) / sum(a), 6) AS value FROM s
UNION ALL SELECT 'precision', round(sum(a * pr) / sum(a), 6) FROM s
UNION ALL SELECT 'recall', round(sum(a * re) / sum(a), 6) FROM s
UNION ALL SELECT 'f1', round(sum(a * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END) / sum(a), 6) FROM s""").replace(")\n,", "),"))
def q_class_metrics(spark, sf_dir):
    return rounded(ml.classification_metrics(ml.confusion_matrix(_guesses(spark, sf_dir))), 6)


@query("q_regression_metrics", """WITH d AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)
SELECT 'r2' AS metric, round(1 - sum((y - p) ^ 2) / (SELECT sum((y - (SELECT avg(y) FROM d)) ^ 2) FROM d), 6) AS value FROM d
UNION ALL SELECT 'rmse', round(sqrt(avg((y - p) ^ 2)), 4) FROM d""")
def q_regression_metrics(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction"))
    m = ml.regression_metrics(li)
    return m.select("metric", F.when(F.col("metric") == "r2", F.round("value", 6)).otherwise(F.round("value", 4)).alias("value"))


# ---------------------------------------------------------------- M2, M5, M14: sizes of the forests
@query("q_rf_sizes", """WITH d AS (SELECT CAST(quality AS VARCHAR) AS q FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
c AS (SELECT q, count(*) AS n FROM d GROUP BY q)
SELECT 'test_size' AS metric, CAST(sum(ceil(n * 0.2)) AS DOUBLE) AS value FROM c
UNION ALL SELECT 'train_size', CAST(sum(n - ceil(n * 0.2)) AS DOUBLE) FROM c
UNION ALL SELECT 'class_count:' || q, CAST(n AS DOUBLE) FROM c""")
def q_rf_sizes(spark, sf_dir):
    m = ml.train_baseline(_doc_labels(spark, sf_dir), "quality").metrics
    return m.where("metric in ('test_size', 'train_size') or metric like 'class_count:%'").select("metric", "value")


@query("q_rf_many_classes", """SELECT 'class_count:' || p_brand AS metric, CAST(count(*) AS DOUBLE) AS value FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
UNION ALL SELECT 'rows', CAST(count(*) AS DOUBLE) FROM part WHERE p_brand IS NOT NULL""")
def q_rf_many_classes(spark, sf_dir):
    """25 classes: an unstratified split, with a code for classes of test rows alone."""
    m = ml.train_baseline(read(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_retailprice"), "p_brand").metrics
    sizes = m.where("metric in ('test_size', 'train_size')").agg(F.lit("rows").alias("metric"), F.sum("value").alias("value"))
    return m.where("metric like 'class_count:%'").select("metric", "value").unionByName(sizes)


# ---------------------------------------------------------------- E1, C18, R8
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("q_profile", _union_sql(
    [f"SELECT 'mean' AS name, '{c}' AS key, round(avg({c}), 4) AS value FROM orders" for c in ORDERS_NUM]
    + [f"SELECT 'median', '{c}', round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) FROM orders" for c in ORDERS_NUM]
    + [f"SELECT 'missing', '{c}', CAST(count(*) - count({c}) AS DOUBLE) FROM orders"
       for c in [*ORDERS_NUM, "o_orderstatus", "o_orderdate", "o_orderpriority"]]
    + ["SELECT 'duplicates', 'rows', CAST((SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS DOUBLE)",
       "SELECT 'class', o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_orderstatus",
       "SELECT 'unique', 'o_orderpriority', CAST(count(DISTINCT o_orderpriority) AS DOUBLE) FROM orders",
       f"SELECT 'correlation', feature1 || '|' || feature2, round(correlation, 4) + 0.0 FROM ({_pairs_sql('orders', ORDERS_NUM)}) p"]))
def q_profile(spark, sf_dir):
    """One call of the whole profile; a part of every kind of section."""
    from tabprofile.plans.profile import profile
    p = profile(read(spark, sf_dir, "orders"), "o_orderstatus")
    num, miss, pairs = p["statistics"]["numeric"], p["data_quality"]["missing"], p["bivariate"]["correlation_pairs"]
    return _stack([
        _long(num, "mean", F.col("column_name"), F.col("mean")), _long(num, "median", F.col("column_name"), F.col("median")),
        _long(miss, "missing", F.col("column_name"), F.col("missing")),
        _long(p["data_quality"]["duplicates"], "duplicates", F.lit("rows"), F.col("duplicates")),
        _long(p["target_analysis"]["class_counts"], "class", F.col("class"), F.col("count")),
        _long(p["statistics"]["categorical"].where("column_name = 'o_orderpriority'"), "unique", F.col("column_name"), F.col("unique_count")),
        _long(rounded(pairs, 6), "correlation", F.concat_ws("|", "feature1", "feature2"), F.col("correlation"))])


@query("q_chart_data", """SELECT 'target_classes' AS name, o_orderpriority AS key, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'top_values', o_orderstatus, CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'issues', 'duplicates', CAST((SELECT count(*) FROM orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS DOUBLE)
""" + "".join(f"UNION ALL SELECT 'histograms', '{c}', CAST(count({c}) AS DOUBLE) FROM orders\n" for c in ORDERS_NUM))
def q_chart_data(spark, sf_dir):
    """All chart tables of orders with a class target; each numeric column's bins sum to its rows."""
    from tabprofile.operators.charts import chart_data
    t = chart_data(read(spark, sf_dir, "orders"), "o_orderpriority")
    assert all(f"kde:{c}" in t for c in ORDERS_NUM)
    return _stack([
        _long(t["target_classes"], "target_classes", F.col("class"), F.col("count")),
        _long(t["top_values"].where("column_name = 'o_orderstatus'"), "top_values", F.col("value"), F.col("count")),
        _long(t["issues"].where("issue = 'duplicates'"), "issues", F.col("issue"), F.col("value")),
        _long(t["histograms"].groupBy("column_name").agg(F.sum("count").alias("n")), "histograms", F.col("column_name"), F.col("n"))])


@query("q_batch", "SELECT DISTINCT * FROM orders")
def q_batch(spark, sf_dir):
    """The offline run over orders: its cleaned snapshot, after every table was written."""
    from tabprofile.plans.batch import run_batch
    outputs = run_batch(spark, f"{sf_dir}/orders.parquet", _scratch(spark, "batch"), target=" O_OrderStatus ")
    return spark.read.parquet(outputs["cleaned"])
