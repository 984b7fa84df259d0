"""Overview and numeric statistics (A1-A3, A8-A11, D-c).

Shared work: one fused aggregate per chunk of columns (count, sum, min, max,
moments) and one quantile job for all numeric columns.  Results are long
tables with one row per column, so a table with thousands of columns gives
thousands of rows, never thousands of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.functions.exprs import long_rows
from tabprofile.functions.moments import column_facts
from tabprofile.operators.quantiles import quantiles
from tabprofile.roles import ColumnRoles, normalize, qcol

# Aggregates per fused pass; beyond this the generated code grows past the JIT limits.
CHUNK = 40


def _chunks(cols, size=CHUNK):
    for i in range(0, len(cols), size):
        yield cols[i:i + size]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_moments(df: DataFrame, cols: list[str] | None = None, facts=None) -> DataFrame:
    """``(column_name, count, mean, std, min, max, skewness, kurtosis)`` per
    numeric column: one facts pass (count / min / max / mean) and one pass of
    mean-shifted power sums (see :mod:`tabprofile.functions.moments`).  The
    result has one row per column."""
    from tabprofile.functions.moments import moment_rows
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    schema = ("column_name string, count long, mean double, std double, min double, max double, "
              "skewness double, kurtosis double")
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    return df.sparkSession.createDataFrame(moment_rows(df, cols, facts), schema)


def _quantile_wide(df, cols, probs, names, facts=None):
    q = quantiles(df, cols, probs, facts=facts)
    return q.groupBy("column_name").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in zip(probs, names)])


def materialize(df: DataFrame) -> DataFrame:
    """Pin a small result (O(columns) rows) so several sections reuse it
    without recomputing its job."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def quartiles(df: DataFrame, cols: list[str], facts=None) -> DataFrame:
    """``(column_name, q25, median, q75)``, computed once and pinned (k rows)."""
    return materialize(_quantile_wide(df, cols, [0.25, 0.5, 0.75], ["q25", "median", "q75"], facts))


def describe(df: DataFrame, cols: list[str] | None = None, moments: DataFrame | None = None,
             quarts: DataFrame | None = None) -> DataFrame:
    """``(column_name, count, mean, std, min, q25, median, q75, max)``."""
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    facts = column_facts(df, cols) if (moments is None or quarts is None) and cols else None
    m = numeric_moments(df, cols, facts) if moments is None else moments
    q = quartiles(df, cols, facts) if quarts is None else quarts
    # both sides hold one row per column (bounded by the schema): broadcast
    return (m.join(F.broadcast(q), "column_name", "left")
            .select("column_name", "count", "mean", "std", "min", "q25", "median", "q75", "max"))


def skew_kurtosis(df: DataFrame, cols: list[str] | None = None, moments: DataFrame | None = None) -> DataFrame:
    """``(column_name, skewness, kurtosis)``."""
    m = numeric_moments(normalize(df), cols) if moments is None else moments
    return m.select("column_name", "skewness", "kurtosis")


def distribution(df: DataFrame, cols: list[str] | None = None, moments: DataFrame | None = None,
                 quarts: DataFrame | None = None) -> DataFrame:
    """Mean, median, std, min, max, q25, q75, iqr, skewness, kurtosis."""
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    facts = column_facts(df, cols) if (moments is None or quarts is None) and cols else None
    m = numeric_moments(df, cols, facts) if moments is None else moments
    q = quartiles(df, cols, facts) if quarts is None else quarts
    return (m.join(F.broadcast(q), "column_name", "left")  # one row per column
            .select("column_name", "mean", "median", "std", "min", "max", "q25", "q75",
                    (F.col("q75") - F.col("q25")).alias("iqr"), "skewness", "kurtosis"))


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = 1.5, quarts: DataFrame | None = None) -> DataFrame:
    """``(column_name, q1, q3, lower_bound, upper_bound)``; ``df`` normalised."""
    q = quartiles(df, cols) if quarts is None else quarts
    iqr = F.col("q75") - F.col("q25")
    return q.select("column_name", F.col("q25").alias("q1"), F.col("q75").alias("q3"),
                    (F.col("q25") - F.lit(factor) * iqr).alias("lower_bound"),
                    (F.col("q75") + F.lit(factor) * iqr).alias("upper_bound"))


def _bounds_literals(bounds: DataFrame) -> dict:
    # O(columns) literals: the only thing that crosses to the driver.
    return {r["column_name"]: (r["lower_bound"], r["upper_bound"]) for r in bounds.collect()}


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, factor: float = 1.5,
                 method: str = "iqr", quarts: DataFrame | None = None) -> DataFrame:
    """A10: ``(column_name, method, q1, q3, lower_bound, upper_bound,
    outlier_count, outlier_percentage)``.  Strict comparisons; the
    percentage is over non-missing values.  Only ``iqr`` and ``zscore`` (see
    :func:`zscore_outliers`) look at one column at a time; any other method raises.  Outliers by
    whole rows are in :mod:`tabprofile.operators.isolation`."""
    if method == "zscore":
        return zscore_outliers(df, cols)
    if method != "iqr":
        raise ValueError(f"outlier method not implemented: {method}")
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    bounds = materialize(iqr_bounds(df, cols, factor, quarts))
    lit = _bounds_literals(bounds)
    parts = []
    for chunk in _chunks(cols):
        aggs, items = [], []
        for i, c in enumerate(chunk):
            lo, hi = lit[c]
            x = qcol(c).cast("double")
            cnt = F.count_if((x < lo) | (x > hi)) if lo is not None else F.lit(0).cast("long")
            aggs += [cnt.alias(f"o{i}"), F.count(x).alias(f"n{i}")]
            items.append((c, [F.col(f"o{i}"), F.col(f"n{i}")]))
        parts.append(long_rows(df.agg(*aggs), "column_name", items, ["outlier_count", "n"]))
    counts = _union(parts)
    return (bounds.join(counts, "column_name")
            .select("column_name", F.lit("iqr").alias("method"), "q1", "q3", "lower_bound", "upper_bound",
                    "outlier_count",
                    F.try_divide(F.col("outlier_count") * 100.0, F.col("n")).alias("outlier_percentage")))


def outlier_values(df: DataFrame, cols: list[str] | None = None, factor: float = 1.5,
                   k: int = 10, quarts: DataFrame | None = None) -> DataFrame:
    """A10 "first 10 outliers", re-aimed to be order-free (D3): per column the
    ``k`` outliers farthest from the median, ties by value.

    ``(column_name, rank, value)``.  The per-column ``row_number <= k`` lets
    Spark insert a partial window-group limit before the shuffle, so each task
    ships at most ``k`` rows per column."""
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    q = (quartiles(df, cols) if quarts is None else quarts).collect()  # k rows
    lit = {r["column_name"]: r for r in q}
    members = []
    for c in cols:
        r = lit[c]
        if r["q25"] is None:
            continue
        iqr = r["q75"] - r["q25"]
        lo, hi = r["q25"] - factor * iqr, r["q75"] + factor * iqr
        x = qcol(c).cast("double")
        members.append(F.struct(F.lit(c).alias("column_name"), F.when((x < lo) | (x > hi), x).alias("value"),
                                F.abs(x - F.lit(r["median"])).alias("dist")))
    if not members:
        return df.sparkSession.createDataFrame([], "column_name string, rank int, value double")
    from pyspark.sql import Window
    # inline + where (not a filter lambda) keeps the generator in codegen
    long = df.select(F.inline(F.array(*members))).where(F.col("value").isNotNull())
    w = Window.partitionBy("column_name").orderBy(F.col("dist").desc(), F.col("value").asc())
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column_name", "rank", "value"))


def outlier_rows(df: DataFrame, col: str, factor: float = 1.5) -> DataFrame:
    """D-b: all rows whose ``col`` lies outside ``[q25 - factor * iqr, q75 + factor * iqr]``,
    with all their columns as they are and the two bounds.  A column without values, or
    whose bounds hold every value, gives no row; bounds override columns of their names."""
    lo, hi = _bounds_literals(iqr_bounds(normalize(df.select(qcol(col))), [col], factor))[col]
    x = F.nanvl(qcol(col).cast("double"), F.lit(None).cast("double"))
    out = (x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)
    return df.where(out).withColumn("lower_bound", F.lit(lo).cast("double")).withColumn("upper_bound", F.lit(hi).cast("double"))


def zscore_outliers(df: DataFrame, cols: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """D-c: ``(column_name, method, mean, std, outlier_count, outlier_percentage)``
    with ``|x - mean| / std > threshold`` (sample std)."""
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    m = numeric_moments(df, cols).select("column_name", "mean", "std").collect()
    lit = {r["column_name"]: (r["mean"], r["std"]) for r in m}
    parts = []
    for chunk in _chunks(cols):
        aggs, items = [], []
        for i, c in enumerate(chunk):
            mu, sd = lit[c]
            x = qcol(c).cast("double")
            if mu is None or not sd:
                cnt = F.lit(0).cast("long")
            else:
                cnt = F.count_if(F.abs(x - F.lit(mu)) / F.lit(sd) > threshold)
            aggs += [cnt.alias(f"o{i}"), F.count(x).alias(f"n{i}")]
            items.append((c, [F.lit(mu).cast("double"), F.lit(sd).cast("double"), F.col(f"o{i}"), F.col(f"n{i}")]))
        parts.append(long_rows(df.agg(*aggs), "column_name", items, ["mean", "std", "outlier_count", "n"]))
    return (_union(parts).select("column_name", F.lit("zscore").alias("method"), "mean", "std", "outlier_count",
                                 F.try_divide(F.col("outlier_count") * 100.0, F.col("n")).alias("outlier_percentage")))


def shape(df: DataFrame) -> DataFrame:
    """A1: ``(rows, columns)``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"))


def type_counts(df: DataFrame) -> DataFrame:
    """``(data_type, n_columns, share)`` from the schema."""
    spark = df.sparkSession
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    k = max(len(df.columns), 1)
    return spark.createDataFrame([(t, n, n * 100.0 / k) for t, n in counts.items()],
                                 "data_type string, n_columns long, share double")


def role_counts(df: DataFrame) -> DataFrame:
    """``(role, n_columns)`` for total / numerical / categorical / datetime
    (+ boolean / other, which the reference leaves out of its groups)."""
    r = ColumnRoles.of(df)
    rows = [("total", len(r.columns)), ("numerical", len(r.numeric)), ("categorical", len(r.categorical)),
            ("datetime", len(r.datetime)), ("boolean", len(r.boolean)), ("other", len(r.other))]
    return df.sparkSession.createDataFrame(rows, "role string, n_columns long")


_FIXED_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
                T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8,
                T.TimestampNTZType: 8}


def estimated_bytes(df: DataFrame) -> DataFrame:
    """A2 re-aimed (D4): estimated data bytes = fixed width x non-null count for
    fixed-width columns + UTF-8 byte length for strings/binary + JSON text
    length for nested values.  ``(column_name, bytes)`` long table; one pass."""
    aggs, items = [], []
    for i, f in enumerate(df.schema.fields):
        c = qcol(f.name)
        w = next((v for t, v in _FIXED_WIDTH.items() if isinstance(f.dataType, t)), None)
        if w is not None:
            e = F.count(c) * w
        elif isinstance(f.dataType, T.DecimalType):
            e = F.count(c) * 16
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            e = F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
        else:
            e = F.coalesce(F.sum(F.octet_length(F.to_json(c))), F.lit(0))
        aggs.append(e.cast("long").alias(f"b{i}"))
        items.append((f.name, [F.col(f"b{i}")]))
    return long_rows(df.agg(*aggs), "column_name", items, ["bytes"])


def memory_mb(df: DataFrame) -> DataFrame:
    """One-row total of :func:`estimated_bytes` in MB (1024^2)."""
    return estimated_bytes(df).agg((F.sum("bytes") / (1024.0 * 1024.0)).alias("memory_mb"))
