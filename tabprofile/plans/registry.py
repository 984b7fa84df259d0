"""Registered queries over the driver tables and their DuckDB twins.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over whole tables; the SQL
twin computes the same result independently in DuckDB.  Computed doubles are
rounded on both sides (``round(x, d)``) so the value hash is insensitive to
summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.operators import stats

QUERIES: dict = {}
ORACLE: dict = {}

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int = 4, only: list[str] | None = None) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (only is None or f.name in only):
            out.append(F.round(c, digits).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def R(expr, d):
    """SQL rounding that also folds -0.0 into 0.0 (Spark's round never yields -0.0)."""
    return f"(round({expr}, {d}) + 0.0)"


def _union_sql(parts):
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- A8 describe
def _describe_sql(table, cols, d=4):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({x}), {d}) AS mean, "
            f"round(stddev_samp({x}), {d}) AS std, round(min({x}), {d}) AS min, "
            f"round(quantile_cont({x}, 0.25), {d}) AS q25, round(quantile_cont({x}, 0.5), {d}) AS median, "
            f"round(quantile_cont({x}, 0.75), {d}) AS q75, round(max({x}), {d}) AS max FROM {table}")
    return _union_sql(parts)


@query("q_numeric_describe", _describe_sql("lineitem", LI_NUM))
def q_numeric_describe(spark, sf_dir):
    return rounded(stats.describe(read(spark, sf_dir, "lineitem")), 4)


# ---------------------------------------------------------------- shared views
# FIXTURES.md section 3: the same projections in Spark and in SQL.
DIRTY_LI_SQL = """SELECT l_orderkey, l_linenumber, l_quantity,
       NULLIF(l_discount, 0.0) AS l_discount,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
       l_linestatus,
       CAST(1.0 AS DOUBLE) AS const_num, 'x' AS const_str, CAST(NULL AS DOUBLE) AS empty_num
FROM lineitem"""
DUP_SQL = "SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem"
REVENUE_SQL = """SELECT l_quantity, l_extendedprice, l_discount, l_tax,
       l_extendedprice * (1 - l_discount) AS revenue FROM lineitem"""
DIRTY_NUM = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "const_num", "empty_num"]
DIRTY_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag",
              "l_linestatus", "const_num", "const_str", "empty_num"]
REV_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue"]


def dirty_li(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_discount") != 0.0, F.col("l_discount")).alias("l_discount"),
        F.when(k % 7 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(k % 5 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
        F.lit(1.0).cast("double").alias("const_num"), F.lit("x").alias("const_str"),
        F.lit(None).cast("double").alias("empty_num"))


def dup_view(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")


def revenue_view(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


def with_view(view_sql, body):
    return f"WITH d AS ({view_sql})\n{body}"


# ---------------------------------------------------------------- A9 / A11 / A10
def _skew_sql(c, d=6):
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, "
            + R(f"CASE WHEN count({x}) < 3 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE skewness({x}) END", d) + " AS skewness, "
            + R(f"CASE WHEN count({x}) < 4 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE kurtosis({x}) END", d) + " AS kurtosis "
            f"FROM d")


QUERIES_SKEW_SQL = with_view(DIRTY_LI_SQL, _union_sql([_skew_sql(c) for c in DIRTY_NUM]))


@query("q_skew_kurtosis", QUERIES_SKEW_SQL)
def q_skew_kurtosis(spark, sf_dir):
    return rounded(stats.skew_kurtosis(dirty_li(spark, sf_dir)), 6)


PART_NUM = ["p_partkey", "p_size", "p_retailprice"]


def _dist_sql(c, table, d=4):
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, round(avg({x}), {d}) AS mean, round(quantile_cont({x}, 0.5), {d}) AS median, "
            f"round(stddev_samp({x}), {d}) AS std, round(min({x}), {d}) AS min, round(max({x}), {d}) AS max, "
            f"round(quantile_cont({x}, 0.25), {d}) AS q25, round(quantile_cont({x}, 0.75), {d}) AS q75, "
            f"round(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), {d}) AS iqr, "
            + R(f"CASE WHEN count({x}) < 3 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE skewness({x}) END", 6) + " AS skewness, "
            + R(f"CASE WHEN count({x}) < 4 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE kurtosis({x}) END", 6) + " AS kurtosis "
            f"FROM {table}")


@query("q_distribution", _union_sql([_dist_sql(c, "part") for c in PART_NUM]))
def q_distribution(spark, sf_dir):
    d = stats.distribution(read(spark, sf_dir, "part"))
    return rounded(rounded(d, 6, ["skewness", "kurtosis"]), 4,
                   ["mean", "median", "std", "min", "max", "q25", "q75", "iqr"])


ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def _iqr_sql(c, table, d=4):
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, 'iqr' AS method, round(q1, {d}) AS q1, round(q3, {d}) AS q3,
       round(q1 - 1.5 * (q3 - q1), {d}) AS lower_bound, round(q3 + 1.5 * (q3 - q1), {d}) AS upper_bound,
       CAST((SELECT count_if({x} < b.q1 - 1.5 * (b.q3 - b.q1) OR {x} > b.q3 + 1.5 * (b.q3 - b.q1)) FROM {table}) AS BIGINT) AS outlier_count,
       round((SELECT count_if({x} < b.q1 - 1.5 * (b.q3 - b.q1) OR {x} > b.q3 + 1.5 * (b.q3 - b.q1)) * 100.0 / count({x}) FROM {table}), {d}) AS outlier_percentage
FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table}) b"""


@query("q_iqr_outliers", _union_sql([_iqr_sql(c, "orders") for c in ORD_NUM]))
def q_iqr_outliers(spark, sf_dir):
    return rounded(stats.iqr_outliers(read(spark, sf_dir, "orders")), 4)


def _extremes_sql(cols, table):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, {x} AS value, abs({x} - b.med) AS dist
FROM {table}, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med, quantile_cont({x}, 0.75) AS q3 FROM {table}) b
WHERE {x} < b.q1 - 1.5 * (b.q3 - b.q1) OR {x} > b.q3 + 1.5 * (b.q3 - b.q1)""")
    return f"""SELECT column_name, CAST(rank AS INTEGER) AS rank, value FROM (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY dist DESC, value ASC) AS rank
  FROM ({_union_sql(parts)}) o) r WHERE rank <= 10"""


@query("q_iqr_extremes", _extremes_sql(["event_id", "user_id", "value"], "events"))
def q_iqr_extremes(spark, sf_dir):
    return stats.outlier_values(read(spark, sf_dir, "events"))


# ---------------------------------------------------------------- A1 / A2 / A3
@query("q_shape_types", """SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS numerical,
       CAST(2 AS BIGINT) AS categorical, CAST(1 AS BIGINT) AS datetime FROM orders""")
def q_shape_types(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    r = stats.role_counts(o).collect()  # schema facts, six rows
    k = {x["role"]: x["n_columns"] for x in r}
    return stats.shape(o).select("rows", "columns", F.lit(k["numerical"]).cast("long").alias("numerical"),
                                 F.lit(k["categorical"]).cast("long").alias("categorical"),
                                 F.lit(k["datetime"]).cast("long").alias("datetime"))


@query("q_estimated_bytes", _union_sql(
    [f"SELECT '{c}' AS column_name, CAST(count({c}) * 8 AS BIGINT) AS bytes FROM orders"
     for c in ["o_orderkey", "o_custkey"]]
    + ["SELECT 'o_orderstatus' AS column_name, CAST(coalesce(sum(strlen(o_orderstatus)), 0) AS BIGINT) AS bytes FROM orders",
       "SELECT 'o_totalprice' AS column_name, CAST(count(o_totalprice) * 8 AS BIGINT) AS bytes FROM orders",
       "SELECT 'o_orderdate' AS column_name, CAST(count(o_orderdate) * 8 AS BIGINT) AS bytes FROM orders",
       "SELECT 'o_orderpriority' AS column_name, CAST(coalesce(sum(strlen(o_orderpriority)), 0) AS BIGINT) AS bytes FROM orders"]))
def q_estimated_bytes(spark, sf_dir):
    return stats.estimated_bytes(read(spark, sf_dir, "orders"))


# ---------------------------------------------------------------- A4-A7, C2, C6-C8
from tabprofile.operators import categorical, charts, clean, insights as insights_mod, multivariate, quality, relate, target as target_mod  # noqa: E402


def _missing_sql():
    return with_view(DIRTY_LI_SQL, _union_sql(
        [f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
         f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct FROM d" for c in DIRTY_COLS]))


@query("q_missing", _missing_sql())
def q_missing(spark, sf_dir):
    return rounded(quality.missing(dirty_li(spark, sf_dir)), 6)


def _missing_ranked_sql():
    inner = _union_sql([f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing FROM d"
                        for c in DIRTY_COLS])
    return with_view(DIRTY_LI_SQL, f"""SELECT column_name, missing,
  CAST(row_number() OVER (ORDER BY missing DESC, column_name ASC) AS INTEGER) AS rank
FROM ({inner}) m QUALIFY rank <= 20""")


@query("q_missing_ranked", _missing_ranked_sql())
def q_missing_ranked(spark, sf_dir):
    return quality.missing_ranked(dirty_li(spark, sf_dir), ascending=False, top=20, only_present=False)


def _matrix_sql():
    bucket = "CAST('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), 1, 8) AS BIGINT) % 50"
    return with_view(DIRTY_LI_SQL, _union_sql([f"""SELECT {bucket} AS bucket, '{c}' AS column_name,
  round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM d GROUP BY 1""" for c in DIRTY_COLS]))


@query("q_missing_matrix", _matrix_sql())
def q_missing_matrix(spark, sf_dir):
    return rounded(quality.missing_matrix(dirty_li(spark, sf_dir), buckets=50, key_cols=["l_orderkey", "l_linenumber"]), 6)


@query("q_duplicates", with_view(DUP_SQL, """SELECT CAST(sum(cnt) AS BIGINT) AS rows, CAST(sum(cnt - 1) AS BIGINT) AS duplicates,
  round(sum(cnt - 1) * 100.0 / sum(cnt), 6) AS duplicate_pct
FROM (SELECT count(*) AS cnt FROM d GROUP BY l_returnflag, l_linestatus, l_linenumber) g"""))
def q_duplicates(spark, sf_dir):
    return rounded(quality.duplicates(dup_view(spark, sf_dir)), 6)


@query("q_constant_columns", with_view(DIRTY_LI_SQL, _union_sql(
    [f"SELECT '{c}' AS column_name FROM d HAVING count({c}) = 0 OR min({c}) = max({c})" for c in DIRTY_COLS])))
def q_constant_columns(spark, sf_dir):
    return quality.constant_columns(dirty_li(spark, sf_dir))


def _quality_sql(view_sql, cols, d=6):
    keys = ", ".join(cols)
    miss = " + ".join(f"(count(*) - count({c})) * 100.0 / count(*)" for c in cols)
    return with_view(view_sql, f"""SELECT round(a, {d}) AS avg_missing_pct, round(p, {d}) AS duplicate_pct,
  round(greatest(0.0, least(100.0, 100.0 - 2.0 * a - 5.0 * p)), {d}) AS quality_score,
  round(100.0 - greatest(0.0, least(100.0, 100.0 - 2.0 * a - 5.0 * p)), {d}) AS remainder
FROM (SELECT ({miss}) / {len(cols)} AS a FROM d) m,
     (SELECT sum(cnt - 1) * 100.0 / sum(cnt) AS p FROM (SELECT count(*) AS cnt FROM d GROUP BY {keys}) g) q""")


@query("q_quality_score", _quality_sql(DIRTY_LI_SQL, DIRTY_COLS))
def q_quality_score(spark, sf_dir):
    return rounded(quality.quality_score(dirty_li(spark, sf_dir)), 6)


@query("q_issue_bars", with_view(DUP_SQL, """SELECT 'duplicates' AS issue, CAST(sum(cnt - 1) AS BIGINT) AS value
FROM (SELECT count(*) AS cnt FROM d GROUP BY l_returnflag, l_linestatus, l_linenumber) g
UNION ALL
SELECT 'constant_columns' AS issue, CAST((CASE WHEN min(l_returnflag) = max(l_returnflag) THEN 1 ELSE 0 END)
  + (CASE WHEN min(l_linestatus) = max(l_linestatus) THEN 1 ELSE 0 END)
  + (CASE WHEN min(l_linenumber) = max(l_linenumber) THEN 1 ELSE 0 END) AS BIGINT) AS value FROM d"""))
def q_issue_bars(spark, sf_dir):
    return quality.issue_bars(dup_view(spark, sf_dir))


@query("q_missing_patterns", with_view(DIRTY_LI_SQL, "SELECT " + " || ".join(
    f"(CASE WHEN {c} IS NULL THEN '1' ELSE '0' END)" for c in DIRTY_COLS)
    + " AS pattern, count(*) AS rows FROM d GROUP BY 1"))
def q_missing_patterns(spark, sf_dir):
    return quality.missing_patterns(dirty_li(spark, sf_dir))


# ---------------------------------------------------------------- P1-P5, P7, P12, P13, D-f, D-g
@query("q_drop_empty_cols", with_view(DIRTY_LI_SQL, """SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
  l_extendedprice, l_returnflag, l_linestatus, const_num, const_str FROM d"""))
def q_drop_empty_cols(spark, sf_dir):
    return clean.drop_empty_columns(dirty_li(spark, sf_dir))


@query("q_drop_empty_rows", with_view(DIRTY_LI_SQL, """SELECT l_discount, l_extendedprice, empty_num FROM d
WHERE l_discount IS NOT NULL OR l_extendedprice IS NOT NULL OR empty_num IS NOT NULL"""))
def q_drop_empty_rows(spark, sf_dir):
    return clean.drop_empty_rows(dirty_li(spark, sf_dir).select("l_discount", "l_extendedprice", "empty_num"))


@query("q_dedup", with_view(DIRTY_LI_SQL, """SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM d
WHERE l_returnflag IS NOT NULL OR l_linestatus IS NOT NULL OR l_linenumber IS NOT NULL"""))
def q_dedup(spark, sf_dir):
    d = dirty_li(spark, sf_dir).select("l_returnflag", "l_linestatus", "l_linenumber", "empty_num")
    # the offline cleaning order: empty rows, empty columns, duplicates
    return clean.dedup(clean.drop_empty_columns(clean.drop_empty_rows(d)))


@query("q_sample_rows", """SELECT * FROM orders
ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority, '42')),
  o_orderkey, o_custkey, o_orderstatus, o_orderpriority LIMIT 1000""")
def q_sample_rows(spark, sf_dir):
    return clean.sample_rows(read(spark, sf_dir, "orders"), 1000, seed=42, key_cols=["o_orderkey", "o_custkey", "o_orderstatus",
                                                                                   "o_orderpriority"])


@query("q_sample_repeated", """WITH n AS (SELECT l_returnflag, l_linestatus, l_linenumber,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber) - 1 AS k FROM lineitem)
SELECT l_returnflag, l_linestatus, l_linenumber FROM n ORDER BY md5(concat_ws('|', l_returnflag, l_linestatus,
  CAST(l_linenumber AS VARCHAR), '42', CASE WHEN k > 0 THEN CAST(k AS VARCHAR) END)), 1, 2, 3 LIMIT 1000""")
def q_sample_repeated(spark, sf_dir):
    """42 different rows, many times each: every copy has a chance of its own."""
    return clean.sample_rows(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), 1000, seed=42)


@query("q_dedup_decimals", """SELECT DISTINCT CAST(l_orderkey AS DECIMAL(38,0)) + 12345678901234567890123456789 AS big, l_linenumber % 2 AS odd FROM lineitem""")
def q_dedup_decimals(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    big = (F.col("l_orderkey").cast("decimal(20,0)") + F.lit("12345678901234567890123456789").cast("decimal(37,0)")).cast("decimal(38,0)")
    return clean.dedup(li.select(big.alias("big"), (F.col("l_linenumber") % 2).alias("odd")))


@query("q_cap_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def q_cap_columns(spark, sf_dir):
    return clean.cap_columns(read(spark, sf_dir, "lineitem").drop("l_shipdate"), 5, target="l_returnflag")


def _narrow_sql():
    parts = []
    ints = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}
    for c, t in ints.items():
        parts.append(f"""SELECT '{c}' AS column_name, '{t}' AS from_type, count({c}) * {dict(int=4, bigint=8)[t]} AS held, count({c}) AS n,
  CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
       WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
       WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS to_type FROM lineitem""")
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]:
        parts.append(f"""SELECT '{c}' AS column_name, 'double' AS from_type, count({c}) * 8 AS held, count({c}) AS n,
  CASE WHEN coalesce(max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE))), 0.0) <= 0.0005 THEN 'float' ELSE 'double' END AS to_type
FROM lineitem""")
    width = " ".join(f"WHEN '{t}' THEN {w}" for t, w in dict(tinyint=1, smallint=2, int=4, bigint=8, float=4, double=8).items())
    return f"""SELECT column_name, from_type, to_type, CAST(held - n * CASE to_type {width} END AS BIGINT) AS saved_bytes
FROM ({_union_sql(parts)}) p"""


@query("q_narrow_types", _narrow_sql())
def q_narrow_types(spark, sf_dir):
    return clean.narrowing_plan(read(spark, sf_dir, "lineitem"))


@query("q_derive_product", """SELECT l_orderkey, l_linenumber,
  round(coalesce(TRY_CAST(l_quantity AS DOUBLE), 0.0) * coalesce(TRY_CAST(l_extendedprice AS DOUBLE), 0.0), 4) AS Sales
FROM lineitem""")
def q_derive_product(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(target_mod.derive_product(li, "l_quantity", "l_extendedprice", "Sales")
                   .select("l_orderkey", "l_linenumber", "Sales"), 4)


@query("q_coerce_numeric", """SELECT event_id, TRY_CAST(mixed AS DOUBLE) AS mixed FROM (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE CAST(value AS VARCHAR) END AS mixed FROM events)
WHERE TRY_CAST(mixed AS DOUBLE) IS NOT NULL""")
def q_coerce_numeric(spark, sf_dir):
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.col("value").cast("string"))
    return clean.coerce_numeric(read(spark, sf_dir, "events").select("event_id", mixed.alias("mixed")), "mixed")


def _fill_sql():
    num = [f"SELECT '{c}' AS column_name, 'median' AS strategy, CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS VARCHAR) AS fill_value FROM d"
           for c in ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "const_num", "empty_num"]]
    cat = [f"""SELECT '{c}' AS column_name, 'most_frequent' AS strategy,
  (SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1) AS fill_value"""
           for c in ["l_returnflag", "l_linestatus", "const_str"]]
    return with_view(DIRTY_LI_SQL, _union_sql(num + cat))


@query("q_impute", _fill_sql())
def q_impute(spark, sf_dir):
    return clean.fill_values(dirty_li(spark, sf_dir))


@query("q_standardize", """SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) + 0.0 AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) + 0.0 AS l_extendedprice
FROM lineitem""")
def q_standardize(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return rounded(clean.standardize(li, ["l_quantity", "l_extendedprice"], keep=["l_orderkey", "l_linenumber"]), 6)


# ---------------------------------------------------------------- A12-A14, A16, A17, B5, T1, T2, W1
CUST_CAT = ["c_name", "c_mktsegment"]


def _cat_stats_sql(cols, table):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column_name,
  (SELECT count(DISTINCT {c}) FROM {table}) AS unique_count,
  (SELECT count(*) - count({c}) FROM {table}) AS missing_count,
  (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS most_common,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})) AS most_common_count,
  (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n ASC, v LIMIT 1) AS least_common,
  (SELECT min(n) FROM (SELECT count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})) AS least_common_count""")
    return _union_sql(parts)


@query("q_category_stats", _cat_stats_sql(CUST_CAT, "customer"))
def q_category_stats(spark, sf_dir):
    return categorical.category_stats(read(spark, sf_dir, "customer"), CUST_CAT)


PART_CAT = ["p_name", "p_brand", "p_type"]


def _top_sql(cols, table, k=10):
    inner = _union_sql([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {table} "
                        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols])
    return f"""SELECT column_name, CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC) AS rank FROM ({inner}) v
) r WHERE rank <= {k}"""


@query("q_top_values", _top_sql(PART_CAT, "part"))
def q_top_values(spark, sf_dir):
    return categorical.top_values(read(spark, sf_dir, "part"), PART_CAT, k=10)


@query("q_value_counts", _union_sql([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count "
                                     f"FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
                                     for c in ["o_orderstatus", "o_orderpriority"]]))
def q_value_counts(spark, sf_dir):
    return categorical.value_counts(read(spark, sf_dir, "orders"))


@query("q_distinct_count", _union_sql([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct FROM customer"
                                       for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]]))
def q_distinct_count(spark, sf_dir):
    return categorical.distinct_count(read(spark, sf_dir, "customer"),
                                      ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query("q_class_counts", """SELECT o_orderstatus AS class, count(*) AS count FROM orders
WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def q_class_counts(spark, sf_dir):
    return target_mod.class_counts(read(spark, sf_dir, "orders"), "o_orderstatus")


def _balance_sql(table, col):
    return f"""SELECT CAST(count(*) AS BIGINT) AS n_classes, min(n) AS min_count, max(n) AS max_count,
  round(min(n) * 1.0 / max(n), 6) AS ratio,
  CASE WHEN min(n) * 1.0 / max(n) > 0.8 THEN 'balanced' WHEN min(n) * 1.0 / max(n) > 0.5 THEN 'moderately_imbalanced'
       ELSE 'highly_imbalanced' END AS balance
FROM (SELECT {col}, count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY {col}) c"""


@query("q_class_balance", _balance_sql("labels", "quality"))
def q_class_balance(spark, sf_dir):
    return rounded(target_mod.class_balance(read(spark, sf_dir, "labels"), "quality"), 6)


@query("q_class_balance_orders", _balance_sql("orders", "o_orderstatus"))
def q_class_balance_orders(spark, sf_dir):
    return rounded(target_mod.class_balance(read(spark, sf_dir, "orders"), "o_orderstatus"), 6)


@query("q_target_profile_class", """SELECT 'o_orderstatus' AS target, 'classification' AS type,
  (SELECT count(*) - count(o_orderstatus) FROM orders) AS missing_count, n_classes, balance,
  NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
  NULL::DOUBLE AS q25, NULL::DOUBLE AS q75, NULL::DOUBLE AS iqr, NULL::DOUBLE AS skewness, NULL::DOUBLE AS kurtosis,
  NULL::DOUBLE AS outlier_percentage, NULL::BIGINT AS outlier_count
FROM (""" + _balance_sql("orders", "o_orderstatus") + ") b")
def q_target_profile_class(spark, sf_dir):
    return target_mod.target_profile(read(spark, sf_dir, "orders"), "o_orderstatus")


@query("q_target_profile_numeric", """WITH s AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT 'o_totalprice' AS target, 'regression' AS type, count(*) - count(o_totalprice) AS missing_count,
  NULL::BIGINT AS n_classes, NULL::VARCHAR AS balance,
  round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
  round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max,
  round(any_value(s.q1), 4) AS q25, round(any_value(s.q3), 4) AS q75, round(any_value(s.q3 - s.q1), 4) AS iqr,
  round(skewness(o_totalprice), 6) + 0.0 AS skewness, round(kurtosis(o_totalprice), 6) + 0.0 AS kurtosis,
  round(count_if(o_totalprice < s.q1 - 1.5 * (s.q3 - s.q1) OR o_totalprice > s.q3 + 1.5 * (s.q3 - s.q1)) * 100.0 / count(o_totalprice), 4) AS outlier_percentage,
  CAST(count_if(o_totalprice < s.q1 - 1.5 * (s.q3 - s.q1) OR o_totalprice > s.q3 + 1.5 * (s.q3 - s.q1)) AS BIGINT) AS outlier_count
FROM orders, s""")
def q_target_profile_numeric(spark, sf_dir):
    t = target_mod.target_profile(read(spark, sf_dir, "orders"), "o_totalprice")
    return rounded(rounded(t, 6, ["skewness", "kurtosis"]), 4,
                   ["mean", "median", "std", "min", "max", "q25", "q75", "iqr", "outlier_percentage"])


@query("q_crosstab", """SELECT l_returnflag AS a_value, l_linestatus AS b_value, count(*) AS count FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2""")
def q_crosstab(spark, sf_dir):
    return categorical.crosstab(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


def _chi_sql(table, a, b, yates):
    adj = "(abs(o - e) - least(0.5, abs(o - e)))" if yates else "abs(o - e)"
    return f"""WITH t AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {table}
                WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS r FROM t GROUP BY a), cb AS (SELECT b, sum(o) AS c FROM t GROUP BY b),
n AS (SELECT sum(o) AS n FROM t),
g AS (SELECT ra.a, cb.b, ra.r * cb.c * 1.0 / n.n AS e FROM ra, cb, n),
cells AS (SELECT g.a, g.b, coalesce(t.o, 0) AS o, g.e FROM g LEFT JOIN t ON g.a = t.a AND g.b = t.b)
SELECT round(sum({adj} * {adj} / e), 4) AS chi2, CAST(((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS BIGINT) AS dof,
  CAST((SELECT n FROM n) AS BIGINT) AS n, {'true' if yates else 'false'} AS yates FROM cells"""


@query("q_chi_square", _chi_sql("labels", "quality", "toxic", True))
def q_chi_square(spark, sf_dir):
    return rounded(categorical.chi_square(read(spark, sf_dir, "labels"), "quality", "toxic"), 4)


@query("q_chi_square_rxc", _chi_sql("orders", "o_orderstatus", "o_orderpriority", False))
def q_chi_square_rxc(spark, sf_dir):
    return rounded(categorical.chi_square(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), 4)


# ---------------------------------------------------------------- A15, B1-B4, K1, K2, X2, C11, C12, C14
LI_FEATS = [c for c in LI_NUM]


def _group_moments_sql(table, target, feats):
    return _union_sql([f"""SELECT '{f}' AS feature, CAST({target} AS VARCHAR) AS class, count({f}) AS n,
  round(avg(CAST({f} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({f} AS DOUBLE)), 4) AS std
FROM {table} WHERE {target} IS NOT NULL GROUP BY {target}""" for f in feats])


@query("q_group_moments", _group_moments_sql("lineitem", "l_returnflag", LI_FEATS))
def q_group_moments(spark, sf_dir):
    return rounded(relate.group_moments(read(spark, sf_dir, "lineitem"), "l_returnflag", LI_FEATS), 4)


def _anova_sql(table, target, feats):
    parts = []
    for f in feats:
        x = f"CAST({f} AS DOUBLE)"
        parts.append(f"""SELECT '{f}' AS feature, CAST(count(*) AS BIGINT) AS groups,
  round(CASE WHEN count(*) < 2 THEN 0.0 ELSE
    (sum(n * (m - (SELECT avg({x}) FROM {table} WHERE {target} IS NOT NULL AND {f} IS NOT NULL)) ^ 2) / (count(*) - 1))
    / NULLIF(sum(coalesce(v * (n - 1), 0.0)) / (sum(n) - count(*)), 0.0) END, 4) AS f_stat
FROM (SELECT {target}, count({x}) AS n, avg({x}) AS m, var_samp({x}) AS v FROM {table}
      WHERE {target} IS NOT NULL AND {f} IS NOT NULL GROUP BY {target}) g""")
    return _union_sql(parts)


@query("q_anova", _anova_sql("lineitem", "l_returnflag", LI_FEATS))
def q_anova(spark, sf_dir):
    return rounded(relate.anova(read(spark, sf_dir, "lineitem"), "l_returnflag", LI_FEATS), 4)


def _pairs_sql(view, cols, d=6):
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            parts.append(f"""SELECT {i} AS i, {j} AS j, '{a}' AS feature1, '{b}' AS feature2,
  round(CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) = 0 OR stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) = 0
        THEN NULL ELSE corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END, {d}) + 0.0 AS correlation FROM {view}""")
    return _union_sql(parts)


@query("q_corr_pairs", with_view(REVENUE_SQL, _pairs_sql("d", REV_NUM)))
def q_corr_pairs(spark, sf_dir):
    return rounded(relate.correlation_pairs(revenue_view(spark, sf_dir)), 6)


@query("q_high_corr", with_view(REVENUE_SQL, f"""SELECT CAST(row_number() OVER (ORDER BY abs(correlation) DESC, i, j) AS INTEGER) AS rank,
  feature1, feature2, round(correlation, 6) AS correlation FROM ({_pairs_sql("d", REV_NUM, 12)}) p WHERE abs(correlation) > 0.7"""))
def q_high_corr(spark, sf_dir):
    return rounded(relate.high_correlations(relate.correlation_pairs(revenue_view(spark, sf_dir))), 6)


@query("q_avg_corr", with_view(REVENUE_SQL, f"""SELECT round(CASE WHEN count_if(correlation IS NULL) > 0 THEN NULL
  ELSE avg(correlation) END, 6) AS avg_correlation FROM ({_pairs_sql("d", REV_NUM, 15)}) p"""))
def q_avg_corr(spark, sf_dir):
    return rounded(relate.avg_correlation(relate.correlation_pairs(revenue_view(spark, sf_dir))), 6)


@query("q_corr_heatmap", f"""SELECT feature2 AS row_feature, feature1 AS col_feature, correlation
FROM ({_pairs_sql("lineitem", LI_NUM)}) p""")
def q_corr_heatmap(spark, sf_dir):
    return rounded(relate.corr_heatmap(read(spark, sf_dir, "lineitem")), 6)


@query("q_corr_matrix", f"""WITH p AS ({_pairs_sql("d", REV_NUM)})
SELECT feature1, feature2, correlation FROM p
UNION ALL SELECT feature2 AS feature1, feature1 AS feature2, correlation FROM p
UNION ALL """ + _union_sql([f"SELECT '{c}' AS feature1, '{c}' AS feature2, CASE WHEN min({c}) < max({c}) THEN 1.0 END AS correlation FROM d"
                            for c in REV_NUM]).replace("WITH p", "WITH p"))
def q_corr_matrix(spark, sf_dir):
    return rounded(relate.corr_matrix(revenue_view(spark, sf_dir)), 6)


ORACLE["q_corr_matrix"] = "WITH d AS (" + REVENUE_SQL + "), " + ORACLE["q_corr_matrix"][len("WITH "):]


def _ft_sql(view, target, feats):
    parts = []
    for f in feats:
        r = (f"CASE WHEN stddev_pop(CASE WHEN {target} IS NOT NULL THEN {f} END) = 0 OR "
             f"stddev_pop(CASE WHEN {f} IS NOT NULL THEN {target} END) = 0 THEN NULL "
             f"ELSE corr(CAST({f} AS DOUBLE), CAST({target} AS DOUBLE)) END")
        parts.append(f"""SELECT '{f}' AS feature, round({r}, 6) + 0.0 AS correlation,
  CASE WHEN abs({r}) >= 0.8 THEN 'very_strong' WHEN abs({r}) >= 0.6 THEN 'strong' WHEN abs({r}) >= 0.4 THEN 'moderate'
       WHEN abs({r}) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS strength FROM {view}""")
    return _union_sql(parts)


@query("q_feature_target_corr", _ft_sql("lineitem", "l_extendedprice", [c for c in LI_NUM if c != "l_extendedprice"]))
def q_feature_target_corr(spark, sf_dir):
    return rounded(relate.feature_target_corr(read(spark, sf_dir, "lineitem"), "l_extendedprice"), 6)


@query("q_feature_importance", with_view(REVENUE_SQL, f"""SELECT CAST(rank AS INTEGER) AS rank, feature, round(importance, 6) AS importance,
  CASE WHEN rank <= 5 THEN round(importance * 100.0 / sum(CASE WHEN rank <= 5 THEN importance END) OVER (), 6) END AS share,
  rank <= 5 AS is_top
FROM (SELECT feature, abs(correlation) AS importance, row_number() OVER (ORDER BY abs(correlation) DESC NULLS LAST, feature) AS rank
      FROM ({_ft_sql("d", "revenue", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).replace("round(", "(").replace(", 6) + 0.0 AS correlation", ") AS correlation")}) c) r"""))
def q_feature_importance(spark, sf_dir):
    return rounded(relate.feature_importance(revenue_view(spark, sf_dir), "revenue"), 6)


@query("q_pca_variance")
def q_pca_variance(spark, sf_dir):
    return rounded(multivariate.pca_variance(read(spark, sf_dir, "lineitem")), 6)


@query("q_pca_summary")
def q_pca_summary(spark, sf_dir):
    return rounded(multivariate.pca_summary(read(spark, sf_dir, "lineitem")), 6)


# ---------------------------------------------------------------- C9, C12, C14, C15, C17
def _hist_sql(table, col, bins=30, d=6):
    # a value's bin is the last edge at or below it, counted edge by edge
    return f"""WITH r AS (SELECT min(CAST({col} AS DOUBLE)) AS lo0, max(CAST({col} AS DOUBLE)) AS hi0, count({col}) AS n FROM {table}),
r2 AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi, n FROM r),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})),
e AS (SELECT bin, bin * ((hi - lo) / {bins}) + lo AS edge FROM g, r2),
v AS (SELECT CAST({col} AS DOUBLE) AS x, count(*) AS c FROM {table} WHERE {col} IS NOT NULL GROUP BY 1),
b AS (SELECT bin, sum(c) AS c FROM (SELECT x, c, max(bin) AS bin FROM v JOIN e ON edge <= x GROUP BY x, c) GROUP BY bin)
SELECT g.bin, round(r2.lo + g.bin * ((r2.hi - r2.lo) / {bins}), {d}) AS bin_start,
  round(r2.lo + (g.bin + 1) * ((r2.hi - r2.lo) / {bins}), {d}) AS bin_end, CAST(coalesce(b.c, 0) AS BIGINT) AS count,
  round(coalesce(b.c, 0) / (r2.n * ((r2.hi - r2.lo) / {bins})), 9) AS density
FROM g CROSS JOIN r2 LEFT JOIN b ON g.bin = b.bin WHERE r2.n > 0"""


def _hists_sql(table, cols):
    return _union_sql([f"SELECT '{c}' AS column_name, * FROM ({_hist_sql(table, c)})" for c in cols])


@query("q_histogram_discount", _hist_sql("lineitem", "l_discount"))
def q_histogram_discount(spark, sf_dir):
    h = charts.histogram(read(spark, sf_dir, "lineitem"), "l_discount")
    return rounded(rounded(h, 6, ["bin_start", "bin_end"]), 9, ["density"])


@query("q_chart_histograms", _hists_sql("lineitem", LI_NUM))
def q_chart_histograms(spark, sf_dir):
    h = charts.chart_data(read(spark, sf_dir, "lineitem").select(*LI_NUM))["histograms"]
    return rounded(rounded(h, 6, ["bin_start", "bin_end"]), 9, ["density"])


@query("q_histogram", _hist_sql("events", "value"))
def q_histogram(spark, sf_dir):
    h = charts.histogram(read(spark, sf_dir, "events"), "value")
    return rounded(rounded(h, 6, ["bin_start", "bin_end"]), 9, ["density"])


@query("q_histogram_target", _hist_sql("orders", "o_totalprice"))
def q_histogram_target(spark, sf_dir):
    h = charts.histogram(read(spark, sf_dir, "orders"), "o_totalprice")
    return rounded(rounded(h, 6, ["bin_start", "bin_end"]), 9, ["density"])


@query("q_histogram_counts", f"SELECT 'l_orderkey' AS column_name, bin, bin_start, bin_end, count FROM ({_hist_sql('lineitem', 'l_orderkey')})")
def q_histogram_counts(spark, sf_dir):
    return rounded(charts.first_numeric_histogram(read(spark, sf_dir, "lineitem")), 6)


@query("q_kde", """WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(p_retailprice) AS n,
  stddev_samp(p_retailprice) * pow(count(p_retailprice), -0.2) AS h FROM part),
g AS (SELECT CAST(range AS INTEGER) AS point FROM range(100))
SELECT g.point, round(r.lo + g.point * ((r.hi - r.lo) / 99), 6) AS x,
  round(sum(exp(-0.5 * pow(((r.lo + g.point * ((r.hi - r.lo) / 99)) - p.p_retailprice) / r.h, 2))) / (r.n * r.h * sqrt(2 * pi())), 9) AS density
FROM g CROSS JOIN r CROSS JOIN part p WHERE p.p_retailprice IS NOT NULL GROUP BY g.point, r.lo, r.hi, r.n, r.h""")
def q_kde(spark, sf_dir):
    k = charts.kde(read(spark, sf_dir, "part"), "p_retailprice")
    return rounded(rounded(k, 6, ["x"]), 9, ["density"])


@query("q_top_corr_chart", with_view(REVENUE_SQL, f"""SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY abs(correlation) DESC, i, j) AS INTEGER) AS rank, feature1, feature2,
    round(correlation, 6) AS correlation, abs(correlation) > 0.8 AS very_high
  FROM ({_pairs_sql("d", REV_NUM, 15)}) p WHERE abs(correlation) > 0.7) t WHERE rank <= 10"""))
def q_top_corr_chart(spark, sf_dir):
    return rounded(relate.top_correlations_chart(relate.correlation_pairs(revenue_view(spark, sf_dir))), 6)


# ---------------------------------------------------------------- I1, R1, R2, R3
def _insights_sql(view_sql, cols, n_num, n_cat, dup_keys, target=None):
    miss = " + ".join(f"(count(*) - count({c}))" for c in cols)
    pct = " + ".join(f"(count(*) - count({c})) * 100.0 / count(*)" for c in cols)
    bal = ""
    if target:
        bal = f""",
b AS (SELECT CASE WHEN min(n) * 1.0 / max(n) > 0.8 THEN 'balanced' WHEN min(n) * 1.0 / max(n) > 0.5
             THEN 'moderately_imbalanced' ELSE 'highly_imbalanced' END AS balance
      FROM (SELECT count(*) AS n FROM d WHERE {target} IS NOT NULL GROUP BY {target}) c)"""
    rows = [
        "SELECT 1 AS seq, 'data_quality_insights' AS category, 'Dataset has ' || CAST(tm AS VARCHAR) || ' missing values that need attention' AS insight FROM m WHERE tm > 0",
        "SELECT 2, 'data_quality_insights', 'Found ' || CAST(dups AS VARCHAR) || ' duplicate rows that should be removed' FROM q WHERE dups > 0",
    ]
    if n_num:
        rows.append(f"SELECT 3, 'feature_insights', 'Dataset has {n_num} numerical features for analysis'")
    if n_cat:
        rows.append(f"SELECT 4, 'feature_insights', 'Dataset has {n_cat} categorical features for encoding'")
    rows.append("SELECT 5, 'recommendations', 'Consider data cleaning before analysis' FROM m, q "
                "WHERE greatest(0.0, least(100.0, 100.0 - 2.0 * m.ap - 5.0 * q.dp)) < 80")
    if n_num > 10:
        rows.append("SELECT 6, 'recommendations', 'Consider dimensionality reduction for high-dimensional data'")
    if target:
        rows.append("SELECT 7, 'recommendations', 'Target is highly imbalanced - consider resampling techniques' "
                    "FROM b WHERE balance = 'highly_imbalanced'")
    return f"""WITH d AS ({view_sql}),
m AS (SELECT {miss} AS tm, ({pct}) / {len(cols)} AS ap FROM d),
q AS (SELECT sum(cnt - 1) AS dups, sum(cnt - 1) * 100.0 / sum(cnt) AS dp FROM (SELECT count(*) AS cnt FROM d GROUP BY {dup_keys}) g){bal}
SELECT seq, category, insight FROM (
{_union_sql(rows)}) r"""


@query("q_insights", _insights_sql(DIRTY_LI_SQL, DIRTY_COLS, 7, 3, ", ".join(DIRTY_COLS)))
def q_insights(spark, sf_dir):
    return insights_mod.insights(dirty_li(spark, sf_dir))


ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("q_insights_target", _insights_sql("SELECT * FROM orders", ORD_COLS, 3, 2, ", ".join(ORD_COLS),
                                          target="o_orderstatus"))
def q_insights_target(spark, sf_dir):
    return insights_mod.insights(read(spark, sf_dir, "orders"), "o_orderstatus")


def _summary_sql():
    miss = " + ".join(f"(count(*) - count({c}))" for c in DIRTY_COLS)
    pct = " + ".join(f"(count(*) - count({c})) * 100.0 / count(*)" for c in DIRTY_COLS)
    fixed = {"l_orderkey": 8, "l_linenumber": 4, "l_quantity": 8, "l_discount": 8, "l_extendedprice": 8,
             "const_num": 8, "empty_num": 8}
    byt = " + ".join([f"count({c}) * {w}" for c, w in fixed.items()]
                     + [f"coalesce(sum(strlen({c})), 0)" for c in ["l_returnflag", "l_linestatus", "const_str"]])
    return with_view(DIRTY_LI_SQL, f"""SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM d
UNION ALL SELECT 'columns', CAST({len(DIRTY_COLS)} AS DOUBLE)
UNION ALL SELECT 'memory_mb', round(({byt}) / (1024.0 * 1024.0), 6) FROM d
UNION ALL SELECT 'quality_score', round(greatest(0.0, least(100.0, 100.0 - 2.0 * (({pct}) / {len(DIRTY_COLS)})
    - 5.0 * (SELECT sum(cnt - 1) * 100.0 / sum(cnt) FROM (SELECT count(*) AS cnt FROM d GROUP BY {", ".join(DIRTY_COLS)}) g))), 6) FROM d
UNION ALL SELECT 'total_missing', CAST({miss} AS DOUBLE) FROM d
UNION ALL SELECT 'duplicates', CAST((SELECT sum(cnt - 1) FROM (SELECT count(*) AS cnt FROM d GROUP BY {", ".join(DIRTY_COLS)}) g) AS DOUBLE)""")


@query("q_summary_table", _summary_sql())
def q_summary_table(spark, sf_dir):
    from tabprofile.plans.report import summary_table
    return rounded(summary_table(dirty_li(spark, sf_dir)), 6)


def _numeric_table_sql():
    parts = []
    for c in DIRTY_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({x}), 4) AS mean, "
            f"round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min, "
            f"round(quantile_cont({x}, 0.25), 4) AS q25, round(quantile_cont({x}, 0.5), 4) AS median, "
            f"round(quantile_cont({x}, 0.75), 4) AS q75, round(max({x}), 4) AS max, "
            + R(f"CASE WHEN count({x}) < 3 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE skewness({x}) END", 6)
            + " AS skewness, "
            + R(f"CASE WHEN count({x}) < 4 THEN NULL WHEN min({x}) = max({x}) THEN 0.0 ELSE kurtosis({x}) END", 6)
            + " AS kurtosis FROM d")
    return with_view(DIRTY_LI_SQL, _union_sql(parts))


@query("q_numeric_table", _numeric_table_sql())
def q_numeric_table(spark, sf_dir):
    from tabprofile.plans.report import numeric_table
    t = numeric_table(dirty_li(spark, sf_dir))
    return rounded(rounded(t, 6, ["skewness", "kurtosis"]), 4,
                   ["mean", "std", "min", "q25", "median", "q75", "max"])


# ---------------------------------------------------------------- M5, M6, W4
SPLIT_KEY_SQL = ("md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, "
                 "o_orderpriority, '42'))")
SPLIT_KEYS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("q_split", f"""SELECT *,
  CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {SPLIT_KEY_SQL}, o_orderkey, o_custkey, o_orderstatus, o_orderpriority) - 1
       < ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM orders WHERE o_orderstatus IS NOT NULL""")
def q_split(spark, sf_dir):
    from tabprofile.operators import split
    return split.stratified_split(read(spark, sf_dir, "orders"), "o_orderstatus", 0.2, 42, key_cols=SPLIT_KEYS)


@query("q_folds", f"""SELECT *,
  CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {SPLIT_KEY_SQL}, o_orderkey, o_custkey, o_orderstatus, o_orderpriority) - 1) % 5 AS INTEGER) AS fold
FROM orders WHERE o_orderstatus IS NOT NULL""")
def q_folds(spark, sf_dir):
    from tabprofile.operators import split
    return split.stratified_folds(read(spark, sf_dir, "orders"), "o_orderstatus", 5, 42, key_cols=SPLIT_KEYS)


@query("q_class_weights", """SELECT class, count, round(sum(count) OVER () / (count(*) OVER () * count), 6) AS weight
FROM (SELECT o_orderstatus AS class, count(*) AS count FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1) c""")
def q_class_weights(spark, sf_dir):
    from tabprofile.operators import split
    return rounded(split.class_weights(read(spark, sf_dir, "orders"), "o_orderstatus"), 6)


# ---------------------------------------------------------------- P14, P15, M1 (name-level + bounded distinct)
@query("q_resolve_target", """SELECT 'l_extendedprice' AS requested, 'l_extendedprice' AS resolved, count(*) AS rows FROM lineitem
UNION ALL SELECT ' L_QUANTITY ', 'l_quantity', count(*) FROM lineitem""")
def q_resolve_target(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    rows = []
    for req in ["l_extendedprice", " L_QUANTITY "]:
        d, col = target_mod.resolve_target(li, req)
        rows.append(d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(req).alias("requested"),
                                                                  F.lit(col).alias("resolved"), "rows"))
    return rows[0].unionByName(rows[1])


@query("q_auto_target", """SELECT 'quality' AS target,
  CASE WHEN (SELECT count(DISTINCT quality) FROM labels) < 20 THEN 'classification' ELSE 'regression' END AS task,
  CAST((SELECT count(DISTINCT quality) FROM labels) AS BIGINT) AS n_classes""")
def q_auto_target(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").select("quality", "toxic", "doc_id")
    t = target_mod.choose_target(lab, None, train=True)
    task = target_mod.infer_task(lab, t)
    return (lab.where(F.col(t).isNotNull()).agg(F.countDistinct(t).alias("n_classes"))
            .select(F.lit(t).alias("target"), F.lit(task).alias("task"), F.col("n_classes").cast("long")))


# ---------------------------------------------------------------- D-c, D-d, D-h, D-i
def _zscore_sql(table, cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, 'zscore' AS method, round(any_value(s.mu), 4) AS mean, round(any_value(s.sd), 4) AS std,
  CAST(count_if(abs({x} - s.mu) / s.sd > 3.0) AS BIGINT) AS outlier_count,
  round(count_if(abs({x} - s.mu) / s.sd > 3.0) * 100.0 / count({x}), 4) AS outlier_percentage
FROM {table}, (SELECT avg({x}) AS mu, stddev_samp({x}) AS sd FROM {table}) s""")
    return _union_sql(parts)


@query("q_zscore", _zscore_sql("events", ["event_id", "user_id", "value"]))
def q_zscore(spark, sf_dir):
    return rounded(stats.zscore_outliers(read(spark, sf_dir, "events")), 4)


@query("q_type_inference")
def q_type_inference(spark, sf_dir):
    from tabprofile.sources.readers import infer_types
    return infer_types(read(spark, sf_dir, "events"))


def _dup_columns_sql(cols: list[str], source: str) -> str:
    # brute force: every pair is checked row by row
    parts = [f"SELECT '{a}' AS column_a, '{b}' AS column_b FROM d HAVING count_if({a} IS DISTINCT FROM {b}) = 0"
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    return f"WITH d AS ({source})\n" + "\nUNION ALL ".join(parts)


DUP_COLUMNS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_copy", "key_copy", "price_again", "empty_a", "empty_b"]


@query("q_dup_columns", "SELECT min_by(column_a, " + f"list_position({DUP_COLUMNS}, column_a)) AS column_a, column_b FROM (" + _dup_columns_sql(
    DUP_COLUMNS, """SELECT *, (l_extendedprice * 2) / 2 AS price_copy, (l_orderkey + 7) - 7 AS key_copy, (l_extendedprice * 4) / 4 AS price_again,
  CASE WHEN l_quantity < 0 THEN l_tax END AS empty_a, CASE WHEN l_quantity < -1 THEN l_tax END AS empty_b FROM lineitem""")
    + ") GROUP BY column_b")
def q_dup_columns(spark, sf_dir):
    """All columns of lineitem and computed copies; groups of three and of empty columns."""
    price, tax, q = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_quantity")
    return quality.duplicate_columns(read(spark, sf_dir, "lineitem").select(
        "*", (price * 2 / 2).alias("price_copy"), ((F.col("l_orderkey") + 7) - 7).alias("key_copy"), (price * 4 / 4).alias("price_again"),
        F.when(q < 0, tax).alias("empty_a"), F.when(q < -1, tax).alias("empty_b")))


@query("q_rules", """SELECT 'discount_range' AS rule, count(*) AS checked,
  count_if(NOT coalesce(l_discount IS NULL OR (l_discount >= 0.0 AND l_discount <= 0.1), false)) AS violations,
  round(count_if(NOT coalesce(l_discount IS NULL OR (l_discount >= 0.0 AND l_discount <= 0.1), false)) * 100.0 / count(*), 6) AS violation_pct FROM lineitem
UNION ALL SELECT 'quantity_positive', count(*), count_if(NOT coalesce(l_quantity IS NULL OR l_quantity >= 1.0, false)),
  round(count_if(NOT coalesce(l_quantity IS NULL OR l_quantity >= 1.0, false)) * 100.0 / count(*), 6) FROM lineitem
UNION ALL SELECT 'flag_format', count(*), count_if(NOT coalesce(l_returnflag IS NULL OR regexp_full_match(l_returnflag, '[AR]'), false)),
  round(count_if(NOT coalesce(l_returnflag IS NULL OR regexp_full_match(l_returnflag, '[AR]'), false)) * 100.0 / count(*), 6) FROM lineitem
UNION ALL SELECT 'price_covers_tax', count(*), count_if(NOT coalesce(l_extendedprice >= l_tax, false)),
  round(count_if(NOT coalesce(l_extendedprice >= l_tax, false)) * 100.0 / count(*), 6) FROM lineitem""")
def q_rules(spark, sf_dir):
    from tabprofile.operators import rules
    li = read(spark, sf_dir, "lineitem")
    r = rules.validate(li, {
        "discount_range": rules.range_rule("l_discount", 0.0, 0.1),
        "quantity_positive": rules.range_rule("l_quantity", 1.0, None),
        "flag_format": rules.format_rule("l_returnflag", "[AR]"),
        "price_covers_tax": F.col("l_extendedprice") >= F.col("l_tax"),
    })
    return rounded(r, 6)


# ---------------------------------------------------------------- M1-M14 (rows-only: forests are randomised)
def _doc_labels(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id").drop("doc_id").withColumn("quality", F.col("quality").cast("string"))


@query("q_rf_classify")
def q_rf_classify(spark, sf_dir):
    from tabprofile.operators import ml
    return ml.train_baseline(_doc_labels(spark, sf_dir), "quality").metrics


@query("q_confusion")
def q_confusion(spark, sf_dir):
    from tabprofile.operators import ml
    return ml.train_baseline(_doc_labels(spark, sf_dir), "quality").confusion


@query("q_rf_importance")
def q_rf_importance(spark, sf_dir):
    from tabprofile.operators import ml
    return ml.train_baseline(_doc_labels(spark, sf_dir), "quality").importances


@query("q_rf_regress")
def q_rf_regress(spark, sf_dir):
    from tabprofile.operators import ml
    o = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice")
    return ml.train_baseline(o, "o_totalprice", task="regression").metrics


@query("q_cv")
def q_cv(spark, sf_dir):
    from tabprofile.operators import ml
    r = ml.train_baseline(_doc_labels(spark, sf_dir), "quality", cv_folds=5)
    return r.metrics.where(F.col("metric").startswith("cv_"))


# ---------------------------------------------------------------- P8, P10, P16, D-f apply, A17 wide, M4
@query("q_drop_missing_target", with_view(DIRTY_LI_SQL, """SELECT l_orderkey, l_linenumber, l_returnflag FROM d
WHERE l_returnflag IS NOT NULL"""))
def q_drop_missing_target(spark, sf_dir):
    return clean.drop_missing_target(dirty_li(spark, sf_dir), "l_returnflag") \
        .select("l_orderkey", "l_linenumber", "l_returnflag")


@query("q_complete_cases", with_view(DIRTY_LI_SQL, """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice
FROM d WHERE l_discount IS NOT NULL AND l_extendedprice IS NOT NULL"""))
def q_complete_cases(spark, sf_dir):
    return clean.complete_cases(dirty_li(spark, sf_dir),
                                ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"])


@query("q_impute_apply", with_view(DIRTY_LI_SQL, """SELECT l_orderkey, l_linenumber,
  coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM d)) AS l_discount,
  coalesce(l_returnflag, (SELECT l_returnflag FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag,
  coalesce(gappy, CAST((SELECT quantile_cont(gappy, 0.5) FROM g) AS INTEGER)) AS gappy
FROM (SELECT *, CASE WHEN l_orderkey % 7 <> 0 THEN l_linenumber END AS gappy FROM d) d0""").replace("WITH d AS","WITH g AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_linenumber END AS gappy FROM lineitem), d AS"))
def q_impute_apply(spark, sf_dir):
    d = dirty_li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_discount", "l_returnflag") \
        .withColumn("gappy", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_linenumber")))
    return clean.impute(d, ["l_discount", "l_returnflag", "gappy"])


@query("q_preview", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate LIMIT 5000")
def q_preview(spark, sf_dir):
    return clean.preview(read(spark, sf_dir, "lineitem"), 5000, order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                                          "l_quantity", "l_extendedprice", "l_shipdate"])


@query("q_crosstab_wide", """SELECT l_returnflag AS a_value, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS F,
  CAST(count_if(l_linestatus = 'O') AS BIGINT) AS O FROM lineitem GROUP BY 1""")
def q_crosstab_wide(spark, sf_dir):
    return categorical.crosstab_wide(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("q_onehot_plan", _union_sql([f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS levels,
  count(DISTINCT {c}) AS kept, count(DISTINCT {c}) AS vector_size FROM customer""" for c in ["c_name", "c_mktsegment"]]))
def q_onehot_plan(spark, sf_dir):
    from tabprofile.operators import ml
    return ml.onehot_plan(read(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


# ---------------------------------------------------------------- S1, S3-S7, R4, R6, R7, K5
def _scratch(spark, name):
    """A fresh folder under the session's shared checkpoint folder."""
    import uuid
    from tabprofile.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("q_csv_roundtrip", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def q_csv_roundtrip(spark, sf_dir):
    from tabprofile.sources import readers, sinks
    path = _scratch(spark, "orders-csv") + ".csv"
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                              "o_orderpriority")
    sinks.write_table(o, path, fmt="csv")
    return readers.load(spark, path)


@query("q_csv_texts", """SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL
UNION ALL SELECT -1 - page_id, html FROM pages WHERE html IS NOT NULL""")
def q_csv_texts(spark, sf_dir):
    """Whole texts and pages, with their quotes, commas and line breaks, through CSV."""
    from tabprofile.sources import readers, sinks
    path = _scratch(spark, "texts-csv") + ".csv"
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(
        read(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("text"))).where("text is not null")
    sinks.write_table(texts, path, fmt="csv")
    return readers.load(spark, path, multiline=True)


@query("q_corr_wide", _pairs_sql("(SELECT " + ", ".join(f"{c} * {k} + l_orderkey % {k + 2} AS {c}_{k}" for k in (1, 2, 3, 5) for c in LI_NUM[1:]) + " FROM lineitem) d",
                                 [f"{c}_{k}" for k in (1, 2, 3, 5) for c in LI_NUM[1:]]))
def q_corr_wide(spark, sf_dir):
    """28 numeric columns, 378 pairs."""
    li = read(spark, sf_dir, "lineitem")
    wide = li.select(*[(F.col(c) * k + F.col("l_orderkey") % (k + 2)).alias(f"{c}_{k}") for k in (1, 2, 3, 5) for c in LI_NUM[1:]])
    return rounded(relate.correlation_pairs(wide), 6)


@query("q_missing_ascending", with_view(DIRTY_LI_SQL, f"""SELECT column_name, missing, CAST(row_number() OVER (ORDER BY missing, column_name) AS INTEGER) AS rank
FROM ({_union_sql([f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing FROM d" for c in DIRTY_COLS])}) m WHERE missing > 0"""))
def q_missing_ascending(spark, sf_dir):
    return quality.missing_ranked(dirty_li(spark, sf_dir), ascending=True)


@query("q_corr_gappy", with_view(DIRTY_LI_SQL, _pairs_sql("d", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "const_num"])))
def q_corr_gappy(spark, sf_dir):
    return rounded(relate.correlation_pairs(dirty_li(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "const_num")), 6)


@query("q_manifest", """SELECT count(*) AS raw_rows, 6 AS raw_columns, (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS cleaned_rows,
  5 AS cleaned_columns, 'o_orderstatus' AS target_column, 'drop_empty_rows,drop_empty_columns,drop_duplicates,cap_columns(5)' AS steps,
  'orders' AS cleaned, 'False' AS train FROM orders""")
def q_manifest(spark, sf_dir):
    from tabprofile.plans.batch import clean_table
    from tabprofile.plans.report import manifest
    raw = read(spark, sf_dir, "orders")
    cleaned, steps = clean_table(raw, max_cols=5, target="o_orderstatus")
    m = manifest(raw, cleaned, steps, "o_orderstatus", {"cleaned": "orders"}, {"train": False})
    return m.select(F.col("raw_shape")[0].alias("raw_rows"), F.col("raw_shape")[1].alias("raw_columns"), F.col("cleaned_shape")[0].alias("cleaned_rows"),
                    F.col("cleaned_shape")[1].alias("cleaned_columns"), "target_column", F.array_join("cleaning_steps", ",").alias("steps"),
                    F.col("outputs")["cleaned"].alias("cleaned"), F.col("flags")["train"].alias("train"))


@query("q_json_rows", """SELECT CAST(to_json({'class': o_orderpriority, 'count': count(*)}) AS VARCHAR) AS json FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def q_json_rows(spark, sf_dir):
    from tabprofile.sources.sinks import to_json_rows
    return to_json_rows(target_mod.class_counts(read(spark, sf_dir, "orders"), "o_orderpriority"))


@query("q_json_load", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_json_load(spark, sf_dir):
    """Whole orders as JSON rows, written, read and parsed again."""
    from tabprofile.sources import sinks
    o = read(spark, sf_dir, "orders").drop("o_orderdate")
    path = _scratch(spark, "orders-json")
    sinks.to_json_rows(o).write.text(path)
    return sinks.parse_json_rows(spark.read.text(path), o.schema, "value")


def _event_runs(spark, sf_dir):
    """A run log with one run for each event."""
    from tabprofile.sources import sinks
    path = _scratch(spark, "runs")
    sinks.append_runs(read(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), "user_id", F.col("event_type").alias("dataset_name"), F.col("value").alias("accuracy"),
        F.col("ts").alias("created_at"), F.col("props").alias("notes")), path)
    return path


@query("q_run_log_latest", """SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(user_id AS INTEGER) AS user_id, event_type AS dataset_name,
  value AS accuracy, 'completed' AS status, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS INTEGER) AS rank
FROM events QUALIFY rank <= 5""")
def q_run_log_latest(spark, sf_dir):
    from tabprofile.sources import sinks
    return sinks.latest_runs(spark, _event_runs(spark, sf_dir), 5).select("run_id", "user_id", "dataset_name", "accuracy", "status", "rank")


@query("q_run_history", """SELECT CAST(event_id AS VARCHAR) AS run_id, event_type AS dataset_name, value AS accuracy, props AS notes,
  CAST(ts AS DATE) AS day FROM events WHERE user_id = (SELECT min(user_id) FROM events)""")
def q_run_history(spark, sf_dir):
    from tabprofile.sources import sinks
    user = read(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return sinks.history(spark, _event_runs(spark, sf_dir), user).select("run_id", "dataset_name", "accuracy", "notes", "day")


@query("q_read_run", """SELECT CAST(event_id AS VARCHAR) AS run_id, CAST(user_id AS INTEGER) AS user_id, event_type AS dataset_name,
  value AS accuracy, props AS notes FROM events WHERE event_id = (SELECT max(event_id) FROM events)""")
def q_read_run(spark, sf_dir):
    from tabprofile.sources import sinks
    last = read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return sinks.read_run(spark, _event_runs(spark, sf_dir), str(last)).select("run_id", "user_id", "dataset_name", "accuracy", "notes")


@query("q_ml_table")
def q_ml_table(spark, sf_dir):
    from tabprofile.operators import ml
    o = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    return ml.ml_table(ml.train_baseline(o, "o_orderstatus"))


ORACLE["q_type_inference"] = _union_sql([f"""SELECT '{c}' AS column_name, count({c}) AS present,
  count(TRY_CAST({c} AS BIGINT)) AS as_long, count(TRY_CAST({c} AS DOUBLE)) AS as_double,
  count(CASE WHEN lower(trim({c})) IN ('true', 'false') THEN {c} END) AS as_boolean,
  CASE WHEN count({c}) = 0 THEN 'string' WHEN count(TRY_CAST({c} AS BIGINT)) = count({c}) THEN 'bigint'
       WHEN count(TRY_CAST({c} AS DOUBLE)) = count({c}) THEN 'double'
       WHEN count(CASE WHEN lower(trim({c})) IN ('true', 'false') THEN {c} END) = count({c}) THEN 'boolean'
       ELSE 'string' END AS inferred FROM events""" for c in ["event_type", "props"]])


# ---------------------------------------------------------------- long-text tables (whole texts)
@query("q_doc_duplicates", """SELECT CAST(sum(cnt) AS BIGINT) AS rows, CAST(sum(cnt - 1) AS BIGINT) AS duplicates,
  round(sum(cnt - 1) * 100.0 / sum(cnt), 6) AS duplicate_pct
FROM (SELECT count(*) AS cnt FROM documents GROUP BY text, lang, source) g""")
def q_doc_duplicates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("text", "lang", "source")
    return rounded(quality.duplicates(d), 6)


@query("q_doc_category_stats", _cat_stats_sql(["text", "lang", "source"], "documents"))
def q_doc_category_stats(spark, sf_dir):
    return categorical.category_stats(read(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("q_text_bytes", """SELECT 'documents.text' AS column_name, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents
UNION ALL SELECT 'pages.html', CAST(coalesce(sum(strlen(html)), 0) AS BIGINT) FROM pages
UNION ALL SELECT 'conversations.text', CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM conversations""")
def q_text_bytes(spark, sf_dir):
    parts = []
    for t, c in [("documents", "text"), ("pages", "html"), ("conversations", "text")]:
        b = stats.estimated_bytes(read(spark, sf_dir, t).select(c))
        parts.append(b.select(F.lit(f"{t}.{c}").alias("column_name"), "bytes"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("q_conv_missing", _union_sql([f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
                                     f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct FROM conversations"
                                     for c in ["conv_id", "turn", "role", "text"]]))
def q_conv_missing(spark, sf_dir):
    return rounded(quality.missing(read(spark, sf_dir, "conversations")), 6)


@query("q_category_extremes", f"""SELECT column_name, most_common, most_common_count, least_common, least_common_count
FROM ({_cat_stats_sql(["o_orderstatus", "o_orderpriority"], "orders")}) s""")
def q_category_extremes(spark, sf_dir):
    s = categorical.category_stats(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return s.select("column_name", "most_common", "most_common_count", "least_common", "least_common_count")


@query("q_importance_share", f"""SELECT feature, CAST(rank AS INTEGER) AS rank,
  round(importance * 100.0 / sum(importance) OVER (), 6) AS share
FROM (SELECT feature, abs(correlation) AS importance,
        row_number() OVER (ORDER BY abs(correlation) DESC NULLS LAST, feature) AS rank
      FROM ({_ft_sql("lineitem", "l_extendedprice", [c for c in LI_NUM if c != "l_extendedprice"]).replace("round(", "(").replace(", 6) + 0.0 AS correlation", ") AS correlation")}) c) r
WHERE rank <= 5""")
def q_importance_share(spark, sf_dir):
    fi = relate.feature_importance(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return rounded(fi.where("is_top").select("feature", "rank", "share"), 6)


from tabprofile.plans import registry_inference, registry_runs, registry_series  # noqa: E402,F401  (add their queries)
