"""Cleaning, capping and reshaping (P1-P12, P16, D-f, D-g).

All are lazy DataFrame transformations; the only driver round trips are
O(columns) facts (which columns are empty, narrowing plan, fill values).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.operators.quality import _counts, has_map, orderable
from tabprofile.operators.quantiles import quantiles
from tabprofile.operators.stats import _chunks
from tabprofile.roles import ColumnRoles, nan_to_null, normalize, qcol
from tabprofile.sources.readers import as_number
from tabprofile.sources.sinks import shared_table


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose every cell is missing (NaN included)."""
    df = nan_to_null(df)
    return df.where(reduce(lambda a, b: a | b, [qcol(c).isNotNull() for c in df.columns])) if df.columns else df


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any non-missing value (all columns of an empty table)."""
    df = nan_to_null(df)
    return [r["column_name"] for r in _counts(df).where("non_null = 0").collect()]  # O(columns)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop all-missing columns (one aggregate decides which)."""
    gone = set(empty_columns(df))
    return df.select(*[qcol(c) for c in df.columns if c not in gone])


def dedup(df: DataFrame) -> DataFrame:
    """Drop duplicate rows (the kept copy is identical, so keep-first is moot).  Columns that
    hold maps, which Spark can't group by, are compared by :func:`orderable`."""
    df = nan_to_null(df)
    plain, maps = _map_columns(df)
    if not maps:
        return df.dropDuplicates()
    rows = plain.groupBy(*[orderable(f).alias(f"k{i}") for i, f in enumerate(plain.schema.fields)]).agg(
        F.first(F.struct(*plain.columns)).alias("r"))
    return rows.select("r.*").toDF(*df.columns)


def _map_columns(df: DataFrame) -> tuple[DataFrame, list[int]]:
    """``df`` with its columns named c0, c1, ..., and the numbers of those that hold maps."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [i for i, f in enumerate(df.schema.fields) if has_map(f.dataType)]


COPY_BLOCK = 4096
KEY_BUCKETS = 16 ** 4  # by the first four hex digits of a row's key


def with_copies(df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """``df`` with ``__copy``: NULL for the first of equal rows, then 1, 2, ...

    Equal rows can't be told apart, so they are counted (combined in each task) and
    written out again with numbers, in blocks spread over the tasks; a row repeated a
    billion times is never one group.  With ``key_cols``, which must identify a row,
    there is nothing to number."""
    if key_cols:
        return df.withColumn("__copy", F.lit(None).cast("long"))
    if _map_columns(df)[1]:
        return _with_map_copies(df)
    same = df.groupBy(*[qcol(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    blocks = same.withColumn("__b", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPY_BLOCK).cast("int"))))
    spread = blocks.repartition(*[qcol(c) for c in df.columns], "__b")
    number = F.explode(F.sequence(F.col("__b").cast("long") * COPY_BLOCK,
                                  F.least(F.col("__n") - 1, (F.col("__b").cast("long") + 1) * COPY_BLOCK - 1)))
    return spread.withColumn("__copy", number).withColumn("__copy", F.when(F.col("__copy") > 0, F.col("__copy"))).drop("__n", "__b")


def _with_map_copies(df: DataFrame) -> DataFrame:
    """:func:`with_copies` for tables with map columns: they travel in a struct beside the
    comparable forms that rows are grouped by."""
    plain, maps = _map_columns(df)
    keys = [orderable(f).alias(f"k{i}") for i, f in enumerate(plain.schema.fields)]
    held = plain.groupBy(*keys).agg(F.first(F.struct(*[f"c{i}" for i in maps])).alias("maps"), F.count(F.lit(1)).alias("n"))
    names = [f"k{i}" for i in range(len(keys))]
    numbered = with_copies(plain.select(*keys), None).withColumnRenamed("__copy", "copy")
    same = F.lit(True)
    for k in names:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = numbered.alias("a").join(held.alias("b"), same)
    out = [F.col(f"b.maps.c{i}") if i in maps else F.col(f"a.k{i}") for i in range(len(names))]
    return both.select(*out, F.col("a.copy")).toDF(*df.columns, "__copy")


def sample_key(df: DataFrame, seed: int = 42, key_cols: list[str] | None = None):
    """Deterministic per-row sort key: md5 of the ``|``-joined key columns, the seed
    and the copy number (:func:`with_copies`) if any.  Independent of partitioning and
    task order."""
    cols = key_cols or [c for c in df.columns if c != "__copy"]
    fields = df.schema
    copy = [F.col("__copy").cast("string")] if "__copy" in df.columns else []
    return F.md5(F.concat_ws("|", *[orderable(fields[c]).cast("string") for c in cols], F.lit(str(seed)), *copy))


def key_bucket(key: str):
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")


def _near_keys(keyed: DataFrame, rows: int, n: int) -> DataFrame:
    """The rows of ``keyed`` whose keys begin low enough that at least ``n`` of ``rows`` should be
    among them, and hardly more, stored; all of them, should the keys fall otherwise."""
    first = math.ceil((n + 10 * math.sqrt(n) + 100) / max(rows, 1) * 65536)  # of the 65,536 key buckets
    if first < 65536:
        near = shared_table(keyed.where(F.col("__k") < F.lit(f"{first:04x}")), "sample")
        if near.count() >= n:
            return near
    return shared_table(keyed, "sample")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key_cols: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, reproducible for a given
    seed: the ``n`` smallest hash keys.  Equal rows have keys of their own, so each is
    as likely as any other row; ``key_cols`` that identify a row save their numbering.

    Rows are counted by key bucket (65,536 counts); buckets wholly below the limit are
    taken as they are, and only the one that crosses it is sorted.  With ``stored`` the rows that
    come into question are stored first, so that the keys of the table are made once."""
    cols = key_cols or df.columns
    keyed = with_copies(df, key_cols)
    keyed = keyed.withColumn("__k", sample_key(keyed, seed, key_cols))
    if stored:
        keyed = _near_keys(keyed, df.count(), n)
    keyed = keyed.withColumn("__h", key_bucket("__k"))
    w = Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)  # over the counts
    upto = keyed.groupBy("__h").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(w))
    edge = upto.where(F.col("upto") >= n).orderBy("__h").first()
    if edge is None:
        return keyed.select(*[qcol(c) for c in df.columns])
    below = keyed.where(F.col("__h") < edge["__h"])
    order = ["__k", *[orderable(df.schema[c]) for c in cols]]
    rest = keyed.where(F.col("__h") == edge["__h"]).orderBy(*order).limit(n - edge["upto"] + edge["c"])
    return below.unionByName(rest).orderBy(*order).select(*[qcol(c) for c in df.columns])


def cap_columns(df: DataFrame, max_cols: int, target: str | None = None) -> DataFrame:
    """P5: the first ``max_cols`` columns; with a present target, the first
    ``max_cols - 1`` others and then the target, last."""
    if len(df.columns) <= max_cols:
        return df
    if target and target in df.columns:
        cols = [c for c in df.columns if c != target][:max_cols - 1] + [target]
    else:
        cols = df.columns[:max_cols]
    return df.select(*[qcol(c) for c in cols])


def preview(df: DataFrame, n: int = 5000, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows (a preview; the limit is the feature), in the order
    of ``order_by`` if given (NULLs first; a task ships at most ``n`` rows)."""
    return df.orderBy(*[qcol(c).asc_nulls_first() for c in order_by]).limit(n) if order_by else df.limit(n)


# Fixed values that must equal the reference's: smallest signed integer type
# that holds [min, max], and float32 when every value survives within an
# absolute 5e-4.
INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647)]
FLOAT_ATOL = 5e-4
WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}
PLAN_CHUNK = 20  # columns an aggregate


def narrowing_plan(df: DataFrame) -> DataFrame:
    """P7 / D-e: ``(column_name, from_type, to_type, saved_bytes)`` for every integer and
    double column, from fused aggregates of min / max / max float error; the bytes
    saved are those of the non-missing values."""
    spark = df.sparkSession
    fields = [f for f in df.schema.fields
              if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType))]
    if not fields:
        return spark.createDataFrame([], "column_name string, from_type string, to_type string, saved_bytes long")
    items = []
    for f in fields:
        c = qcol(f.name)
        if isinstance(f.dataType, T.DoubleType):
            x = F.nanvl(c, F.lit(None).cast("double"))
            err = F.max(F.abs(x - x.cast("float").cast("double")))
            to = F.when(F.coalesce(err, F.lit(0.0)) <= FLOAT_ATOL, "float").otherwise("double")
        else:
            lo, hi = F.min(c), F.max(c)
            to = F.lit("bigint")
            for name, a, b in reversed(INT_RANGES):
                to = F.when((F.coalesce(lo, F.lit(0)) >= a) & (F.coalesce(hi, F.lit(0)) <= b), name).otherwise(to)
        width = F.lit(0)
        for name, size in WIDTHS.items():
            width = F.when(to == name, size).otherwise(width)
        saved = F.count(c) * (F.lit(WIDTHS[f.dataType.simpleString()]) - width)
        items.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("from_type"),
                              to.alias("to_type"), saved.cast("long").alias("saved_bytes")))
    parts = [df.agg(F.array(*chunk).alias("a")).select(F.inline("a")) for chunk in _chunks(items, PLAN_CHUNK)]
    return reduce(DataFrame.unionByName, parts)


def narrow_types(df: DataFrame) -> DataFrame:
    """Apply :func:`narrowing_plan` (a write-time schema choice, D5)."""
    plan = {r["column_name"]: r["to_type"] for r in narrowing_plan(df).collect()}  # O(columns)
    return df.select(*[qcol(c).cast(plan[c]).alias(c) if c in plan else qcol(c) for c in df.columns])


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a present target."""
    return nan_to_null(df).where(qcol(target).isNotNull())


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P10: rows where every given (default: numeric) column is present."""
    df = nan_to_null(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    kept = df.select(*[qcol(c) for c in cols])
    return kept.where(reduce(lambda a, b: a & b, [qcol(c).isNotNull() for c in cols])) if cols else kept


def coerce_numeric(df: DataFrame, col: str) -> DataFrame:
    """``col`` as double, text that is no decimal number (``1D`` is none) -> missing,
    missing rows dropped."""
    return df.withColumn(col, as_number(df, col)).where(qcol(col).isNotNull())


def fill_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D-f / M3: ``(column_name, strategy, fill_value)``: exact (interpolated)
    median for numeric columns, most frequent value for the others (ties to
    the smallest value).  Values are returned as strings."""
    from tabprofile.operators.categorical import top_values
    df = normalize(df)
    roles = ColumnRoles.of(df)
    cols = df.columns if cols is None else cols
    num = [c for c in cols if roles.roles[c] == "numeric"]
    cat = [c for c in cols if roles.roles[c] in ("categorical", "boolean", "datetime")]
    spark = df.sparkSession
    parts = []
    if num:
        q = quantiles(df, num, [0.5])
        parts.append(q.select("column_name", F.lit("median").alias("strategy"),
                              F.col("value").cast("string").alias("fill_value")))
    if cat:
        t = top_values(df, cat, k=1)
        present = t.select("column_name", F.lit("most_frequent").alias("strategy"), F.col("value").alias("fill_value"))
        names = spark.createDataFrame([(c,) for c in cat], "column_name string")
        parts.append(F.broadcast(names).join(present, "column_name", "left")  # one row per column
                     .select("column_name", F.lit("most_frequent").alias("strategy"), "fill_value"))
    if not parts:
        return spark.createDataFrame([], "column_name string, strategy string, fill_value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def impute(df: DataFrame, cols: list[str] | None = None, fills: DataFrame | None = None) -> DataFrame:
    """D-f: fill missing cells with :func:`fill_values` (computed on ``df`` or
    given, e.g. fitted on training rows only).  Types stay, but an integer or
    decimal column whose median isn't one of its values' type becomes double."""
    df = nan_to_null(df)
    f = fill_values(df, cols) if fills is None else fills
    lit = {r["column_name"]: r["fill_value"] for r in f.collect()}  # O(columns)
    out = []
    for fld in df.schema.fields:
        v = lit.get(fld.name)
        c = qcol(fld.name)
        if v is None:
            out.append(c)
        elif isinstance(fld.dataType, (T.IntegralType, T.DecimalType)):
            kind = fld.dataType if float(v).is_integer() and isinstance(fld.dataType, T.IntegralType) else T.DoubleType()
            fill = F.lit(float(v)).cast(kind)
            out.append(F.coalesce(c.cast(kind), fill).alias(fld.name))
        else:
            out.append(F.coalesce(c, F.lit(v).cast(fld.dataType)).alias(fld.name))
    return df.select(*out)


def standardize(df: DataFrame, cols: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """D-g: ``(x - mean) / std`` (sample std) per numeric column; a constant
    column and one with infinite values become NULL.  Means and stds come from one aggregate
    and enter the projection as literals."""
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    row = df.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(cols)]
                 + [F.stddev_samp(qcol(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    keep = keep or []
    return df.select(*[qcol(k) for k in keep],
                     *[F.try_divide(qcol(c) - F.lit(row[f"m{i}"]), F.lit(row[f"s{i}"])).alias(c)
                       if row[f"s{i}"] and math.isfinite(row[f"s{i}"]) else F.lit(None).cast("double").alias(c)
                       for i, c in enumerate(cols)])
