"""Registered queries of the tests of distribution and homogeneity, of isolation forests and of
awkward columns, with their DuckDB twins.

The twins rank every row (``row_number``, ``rank``) where the operators count distinct values,
and sum series term by term where the operators use continued fractions or polynomials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprofile.operators import charts, clean, inference, isolation, ml, quantiles, split
from tabprofile.plans.profile import profile
from tabprofile.plans.registry import (DIRTY_LI_SQL, LI_NUM, ORACLE, SPLIT_KEYS, R, _anova_sql, _hist_sql, _scratch, _union_sql, dirty_li,
                                       query, read, rounded, with_view)
from tabprofile.sources import readers, sinks

FEATURES = [c for c in LI_NUM if c != "l_linenumber"]
# the normal distribution function by z + z^3/3 + z^5/(3*5) + ..., nested from the inside
PHI = """(0.5 + z * exp(-z * z / 2) / sqrt(2 * pi()) * list_reduce(CAST(range(90, 0, -1) AS DOUBLE[]),
  lambda acc, k: 1 + z * z / (2 * k + 1) * acc, 1.0))"""


def _lilliefors(n, d):
    k = f"(CASE WHEN {n} > 100 THEN {d} * pow({n} / 100.0, 0.49) ELSE {d} END)"
    m = f"least({n}, 100)"
    q = f"((sqrt({n}) - 0.01 + 0.85 / sqrt({n})) * {d})"
    p = f"exp(-7.01256 * {k} * {k} * ({m} + 2.78019) + 2.99587 * {k} * sqrt({m} + 2.78019) - 0.122119 + 0.974598 / sqrt({m}) + 1.67997 / {m})"
    return f"""CASE WHEN {p} <= 0.1 THEN {p} WHEN {q} <= 0.302 THEN 1.0
 WHEN {q} <= 0.5 THEN 2.76773 - 19.828315 * {q} + 80.709644 * pow({q}, 2) - 138.55152 * pow({q}, 3) + 81.218052 * pow({q}, 4)
 WHEN {q} <= 0.9 THEN -4.901232 + 40.662806 * {q} - 97.490286 * pow({q}, 2) + 94.029866 * pow({q}, 3) - 32.355711 * pow({q}, 4)
 WHEN {q} <= 1.31 THEN 6.198765 - 19.558097 * {q} + 23.186922 * pow({q}, 2) - 12.234627 * pow({q}, 3) + 2.423045 * pow({q}, 4) ELSE 0.0 END"""


def _anderson(n, a):
    s = f"({a} * (1 + 0.75 / {n} + 2.25 / ({n} * {n})))"
    return f"""CASE WHEN {s} < 0.2 THEN 1 - exp(-13.436 + 101.14 * {s} - 223.73 * {s} * {s}) WHEN {s} < 0.34 THEN 1 - exp(-8.318 + 42.796 * {s} - 59.938 * {s} * {s})
 WHEN {s} < 0.6 THEN exp(0.9177 - 4.279 * {s} - 1.38 * {s} * {s}) WHEN {s} < 10 THEN exp(1.2937 - 5.709 * {s} + 0.0186 * {s} * {s}) ELSE 0.0 END"""


def _normality_sql(table, cols):
    parts = [f"""SELECT feature, n, round(ks, 8) AS ks_stat, round(ks_p, 6) AS ks_p, round(ad, 3) AS ad_stat, round(ad_p, 6) AS ad_p,
  ks_p >= 0.05 AND ad_p >= 0.05 AS normal FROM (SELECT *, {_lilliefors('n', 'ks')} AS ks_p, {_anderson('CAST(n AS DOUBLE)', 'ad')} AS ad_p FROM (
SELECT '{c}' AS feature, count(*) AS n, max(greatest(i / n - p, p - (i - 1) / n)) AS ks,
  -count(*) - sum((2 * i - 1) * ln(p) + (2 * (n - i) + 1) * ln(1 - p)) / count(*) AS ad
FROM (SELECT i, n, {PHI} AS p FROM (SELECT row_number() OVER (ORDER BY x) AS i, CAST(count(*) OVER () AS DOUBLE) AS n,
    (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {table} WHERE {c} IS NOT NULL) a) b) c) d) e"""
             for c in cols]
    return _union_sql(parts)


@query("q_normality", _normality_sql("lineitem", FEATURES))
def q_normality(spark, sf_dir):
    found = rounded(rounded(inference.normality(read(spark, sf_dir, "lineitem"), FEATURES), 8, ["ks_stat"]), 3, ["ad_stat"])
    return rounded(found, 6, ["ks_p", "ad_p"])


@query("q_normality_customers", _normality_sql("customer", ["c_acctbal"]))
def q_normality_customers(spark, sf_dir):
    found = rounded(rounded(inference.normality(read(spark, sf_dir, "customer"), ["c_acctbal"]), 8, ["ks_stat"]), 3, ["ad_stat"])
    return rounded(found, 6, ["ks_p", "ad_p"])


def _ranked(table, target, c):
    return f"""SELECT CAST({target} AS VARCHAR) AS k, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r,
    CAST(count(*) OVER (PARTITION BY x) AS DOUBLE) AS t, CAST(count(*) OVER () AS DOUBLE) AS total
  FROM (SELECT {target}, CAST({c} AS DOUBLE) AS x FROM {table} WHERE {target} IS NOT NULL AND {c} IS NOT NULL) v"""


def _kruskal_sql(table, target, cols):
    """For three classes, so two degrees of freedom: the tail is exp(-h / 2)."""
    return _union_sql([f"""SELECT '{c}' AS feature, groups, n, round(h, 6) AS h_stat, groups - 1 AS dof, round(exp(-h / 2), 8) AS p_value FROM (
SELECT count(*) AS groups, CAST(sum(m) AS BIGINT) AS n,
  (12 / (max(total) * (max(total) + 1)) * sum(s * s / m) - 3 * (max(total) + 1)) / (1 - sum(ties) / (pow(max(total), 3) - max(total))) AS h
FROM (SELECT k, count(*) AS m, sum(r) AS s, max(total) AS total, sum(t * t - 1) AS ties FROM ({_ranked(table, target, c)}) a GROUP BY k) b) d"""
                       for c in cols])


@query("q_kruskal_wallis", _kruskal_sql("lineitem", "l_returnflag", FEATURES))
def q_kruskal_wallis(spark, sf_dir):
    return rounded(rounded(inference.kruskal_wallis(read(spark, sf_dir, "lineitem"), "l_returnflag", FEATURES), 6, ["h_stat"]), 8, ["p_value"])


def _mann_whitney_sql(table, target, cols):
    return _union_sql([f"""SELECT '{c}' AS feature, ka AS class_a, kb AS class_b, na AS n_a, nb AS n_b, u AS u_stat, round(z, 6) AS z,
  round(least(1.0, 2 * (1 - {PHI})), 8) AS p_value FROM (SELECT *, (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(CAST(na AS DOUBLE) * nb / 12 * (na + nb + 1 - ties / ((CAST(na AS DOUBLE) + nb) * (na + nb - 1)))) AS z FROM (
SELECT min(k) AS ka, max(k) AS kb, count(*) FILTER (k = lo) AS na, count(*) FILTER (k != lo) AS nb,
  sum(r) FILTER (k = lo) - CAST(count(*) FILTER (k = lo) AS DOUBLE) * (count(*) FILTER (k = lo) + 1) / 2 AS u, sum(t * t - 1) AS ties
FROM (SELECT *, min(k) OVER () AS lo FROM ({_ranked(table, target, c)}) a) b) d) e""" for c in cols])


@query("q_mann_whitney", _mann_whitney_sql("lineitem", "l_linestatus", FEATURES))
def q_mann_whitney(spark, sf_dir):
    return rounded(rounded(inference.mann_whitney(read(spark, sf_dir, "lineitem"), "l_linestatus", FEATURES), 6, ["z"]), 8, ["p_value"])


def _levene_sql(table, target, cols, center):
    """For three classes; the F tail with two numerator degrees of freedom has a closed form."""
    mid = "quantile_cont(x, 0.5)" if center == "median" else "avg(x)"
    return _union_sql([f"""SELECT '{c}' AS feature, groups, n, round(w, 6) AS w_stat, round(pow(1 + 2 * w / (n - 3), -(n - 3) / 2.0), 8) AS p_value FROM (
SELECT count(*) AS groups, CAST(sum(m) AS BIGINT) AS n, (sum(m * pow(a - g, 2)) / (count(*) - 1)) / (sum(m * v) / (sum(m) - count(*))) AS w
FROM (SELECT k, count(*) AS m, avg(z) AS a, var_pop(z) AS v, max(g) AS g FROM (
  SELECT k, abs(x - mid) AS z, avg(abs(x - mid)) OVER () AS g FROM (SELECT {target} AS k, CAST({c} AS DOUBLE) AS x FROM {table} WHERE {target} IS NOT NULL) r
  JOIN (SELECT {target} AS k2, {mid} AS mid FROM (SELECT {target}, CAST({c} AS DOUBLE) AS x FROM {table}) s GROUP BY {target}) t ON k = k2) u GROUP BY k) q) o"""
                       for c in cols])


@query("q_brown_forsythe", _levene_sql("lineitem", "l_returnflag", FEATURES, "median"))
def q_brown_forsythe(spark, sf_dir):
    return rounded(rounded(inference.levene(read(spark, sf_dir, "lineitem"), "l_returnflag", FEATURES), 6, ["w_stat"]), 8, ["p_value"])


@query("q_levene", _levene_sql("lineitem", "l_returnflag", FEATURES, "mean"))
def q_levene(spark, sf_dir):
    return rounded(rounded(inference.levene(read(spark, sf_dir, "lineitem"), "l_returnflag", FEATURES, "mean"), 6, ["w_stat"]), 8, ["p_value"])


QUARTERS = [0.25, 0.5, 0.9]


@query("q_group_quantiles", _union_sql([f"""SELECT CAST(event_type AS VARCHAR) AS class, 'value' AS column_name, CAST({p} AS DOUBLE) AS prob,
  round(quantile_cont(value, {p}), 6) AS value FROM events WHERE event_type IS NOT NULL GROUP BY event_type""" for p in QUARTERS]
    + [f"""SELECT CAST(event_type AS VARCHAR) AS class, 'user_id' AS column_name, CAST({p} AS DOUBLE) AS prob,
  round(quantile_cont(CAST(user_id AS DOUBLE), {p}), 6) AS value FROM events WHERE event_type IS NOT NULL GROUP BY event_type""" for p in QUARTERS]))
def q_group_quantiles(spark, sf_dir):
    """With few buckets and a low limit, so that refinement passes run on small tables, too."""
    found = quantiles.group_quantiles(read(spark, sf_dir, "events"), ["value", "user_id"], "event_type", QUARTERS, direct_limit=50, buckets=16)
    return rounded(found, 6, ["value"])


@query("q_quantiles_refined", _union_sql([f"""SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS value
  FROM lineitem""" for c in LI_NUM for p in QUARTERS]))
def q_quantiles_refined(spark, sf_dir):
    """A8's quantiles through several refinement passes (64 buckets, direct below 1,000 values)."""
    return rounded(quantiles.quantiles(read(spark, sf_dir, "lineitem"), LI_NUM, QUARTERS, direct_limit=1000, buckets=64), 4, ["value"])


@query("q_anova_test", f"""SELECT a.feature, a.groups, n, f_stat, round(pow(1 + 2 * f / (n - 3), -(n - 3) / 2.0), 6) AS p_value
FROM ({_anova_sql("lineitem", "l_returnflag", FEATURES)}) a JOIN ({_anova_sql("lineitem", "l_returnflag", FEATURES).replace(", 4) AS f_stat", ", 12) AS f")}) b
  ON a.feature = b.feature JOIN (SELECT count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL) c ON true""")
def q_anova_test(spark, sf_dir):
    return rounded(rounded(inference.anova_test(read(spark, sf_dir, "lineitem"), "l_returnflag", FEATURES), 4, ["f_stat"]), 6, ["p_value"])


@query("q_chi_square_test", f"""WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, CAST(count(*) AS DOUBLE) AS o FROM orders GROUP BY ALL),
e AS (SELECT x.a, y.b, ra * cb / (SELECT sum(o) FROM t) AS e FROM (SELECT a, sum(o) AS ra FROM t GROUP BY a) x, (SELECT b, sum(o) AS cb FROM t GROUP BY b) y),
s AS (SELECT sum(pow(coalesce(o, 0) - e, 2) / e) AS chi2, (count(DISTINCT e.a) - 1) * (count(DISTINCT e.b) - 1) AS dof,
  CAST((SELECT sum(o) FROM t) AS BIGINT) AS n FROM e LEFT JOIN t ON e.a = t.a AND e.b = t.b)
SELECT {R('chi2', 4)} AS chi2, dof, n, false AS yates,
  round(exp(-chi2 / 2) * list_reduce(CAST(range(dof // 2 - 1, 0, -1) AS DOUBLE[]), lambda acc, i: 1 + chi2 / 2 / i * acc, 1.0), 8) AS p_value FROM s""")
def q_chi_square_test(spark, sf_dir):
    """The twin's tail is the finite sum for an even number of degrees of freedom."""
    found = inference.chi_square_test(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(rounded(found, 4, ["chi2"]), 8, ["p_value"])


# ---------------------------------------------------------------- D-c: random trees, so no twin (pytest walks them plainly)
@query("q_isolation_scores")
def q_isolation_scores(spark, sf_dir):
    """All rows of lineitem with the score of their numeric columns."""
    return rounded(isolation.isolation_scores(read(spark, sf_dir, "lineitem")), 9, ["anomaly_score"])


@query("q_isolation_outliers")
def q_isolation_outliers(spark, sf_dir):
    return rounded(isolation.isolation_outliers(read(spark, sf_dir, "lineitem")), 9, ["threshold"])


# ---------------------------------------------------------------- M10, C9, S4, P3, P12, D-d, M5, E1 on awkward columns
@query("q_roc_auc", """SELECT p AS positives, n AS negatives, round((s - p * (p + 1) / 2) / (p * n), 9) AS roc_auc FROM (
  SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n, sum(r) FILTER (y) AS s FROM (
    SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS r
    FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL) a) b""")
def q_roc_auc(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("is_r", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(ml.roc_auc(li, "is_r", "l_extendedprice"), 9)


@query("q_histogram_gaps", with_view(DIRTY_LI_SQL, f"SELECT * FROM ({_hist_sql('d', 'l_extendedprice')})"))
def q_histogram_gaps(spark, sf_dir):
    """A column with missing values, which are in no bin."""
    h = charts.histogram(dirty_li(spark, sf_dir), "l_extendedprice")
    return rounded(rounded(h, 6, ["bin_start", "bin_end"]), 9, ["density"])


SPACES_SQL = "' ' || chr(9) || text || ' '"


@query("q_csv_spaces", f"SELECT doc_id, {SPACES_SQL} AS text FROM documents WHERE text IS NOT NULL")
def q_csv_spaces(spark, sf_dir):
    """Whole texts that begin and end in white space and hold line breaks, through CSV."""
    path = _scratch(spark, "spaces-csv") + ".csv"
    docs = read(spark, sf_dir, "documents").where("text is not null")
    sinks.write_table(docs.select("doc_id", F.concat(F.lit(" \t"), "text", F.lit(" ")).alias("text")), path, "csv")
    return readers.load(spark, path, multiline=True)


CODE_SQL = "CAST(l_partkey AS VARCHAR) || CASE l_linenumber % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'F' ELSE '' END"


@query("q_coerce_codes", "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS code FROM lineitem WHERE l_linenumber % 3 = 2")
def q_coerce_codes(spark, sf_dir):
    """Codes such as 17D or 17F are no numbers."""
    end = F.when(F.col("l_linenumber") % 3 == 0, "D").when(F.col("l_linenumber") % 3 == 1, "F").otherwise("")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_partkey").cast("string"), end).alias("code"))
    return clean.coerce_numeric(li, "code")


@query("q_type_kinds_years", """SELECT 'year' AS column_name, CASE WHEN count(DISTINCT strftime(ts, '%Y')) / count(*) < 0.5 THEN 'category' ELSE 'object' END AS kind FROM events
UNION ALL SELECT 'month', 'datetime' UNION ALL SELECT 'code', CASE WHEN count(DISTINCT 10000 + user_id % 90000) / count(*) < 0.5 THEN 'category' ELSE 'object' END FROM events""")
def q_type_kinds_years(spark, sf_dir):
    """Years and five-digit codes are text, months dates."""
    e = read(spark, sf_dir, "events")
    return readers.infer_kinds(e.select(F.date_format("ts", "yyyy").alias("year"), F.date_format("ts", "yyyy-MM").alias("month"),
                                        (10000 + F.col("user_id") % 90000).cast("string").alias("code")))


@query("q_dedup_maps", """SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders""")
def q_dedup_maps(spark, sf_dir):
    """Rows with a map column; the order of its entries doesn't tell rows apart."""
    o = read(spark, sf_dir, "orders")
    forward = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    backward = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus")
    rows = clean.dedup(o.select(F.when(F.col("o_orderkey") % 2 == 0, forward).otherwise(backward).alias("m")))
    return rows.select(F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"))


@query("q_split_clashes", ORACLE["q_split"].replace("SELECT *,", "SELECT * RENAME (o_orderdate AS rn, o_totalprice AS group_size),", 1))
def q_split_clashes(spark, sf_dir):
    """Columns named as the split's own."""
    o = read(spark, sf_dir, "orders").withColumnsRenamed({"o_orderdate": "rn", "o_totalprice": "group_size"})
    return split.stratified_split(o, "o_orderstatus", 0.2, 42, key_cols=SPLIT_KEYS)


@query("q_profile_unknown_target", """SELECT count(*) AS rows, 'no such column' AS target, 'Target column not found' AS error FROM orders""")
def q_profile_unknown_target(spark, sf_dir):
    """An unknown target is an error entry in its own section; the others are there."""
    p = profile(read(spark, sf_dir, "orders"), "no such column")
    return p["overview"]["shape"].select("rows").join(p["target_analysis"]["error"], F.lit(True))


@query("q_model_awkward")
def q_model_awkward(spark, sf_dir):
    """A model on names with dots, an empty level and columns without values: sizes and scores."""
    o = read(spark, sf_dir, "orders")
    awkward = o.withColumnsRenamed({"o_totalprice": "total.price", "o_custkey": "split"}).withColumn("none", F.lit(None).cast("string")) \
        .withColumn("empty.level", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("odd")).drop("o_clerk", "o_comment")
    res = ml.train_baseline(awkward, "o_orderstatus", num_trees=8, max_depth=5)
    return rounded(res.metrics.select("metric", "value"), 6)
