"""Data-quality operators (A4-A7, D-a, D-h).

Missing counts and constant-column checks come from one fused aggregate
with O(1) state per column; the duplicate count is the one full-row
grouping (a shuffle on hashes of the whole row, map-side combined, so a
row repeated a billion times costs one record per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.functions.exprs import long_rows
from tabprofile.operators.stats import CHUNK, _chunks, _union
from tabprofile.roles import nan_to_null, normalize, qcol


def has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.ArrayType):
        return has_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(has_map(x.dataType) for x in dt.fields)
    return False


def orderable(f: T.StructField):
    """The column in a form that can be compared and grouped by: maps as their sorted entries,
    anything that holds maps deeper down as JSON."""
    c, t = qcol(f.name), f.dataType
    if not has_map(t):
        return c
    if isinstance(t, T.MapType) and not has_map(t.keyType) and not has_map(t.valueType):
        return F.array_sort(F.map_entries(c))
    return F.to_json(c)


def _counts(df: DataFrame) -> DataFrame:
    """``(column_name, non_null, missing, rows)``: counts alone, so a plain hash aggregate."""
    parts = []
    for chunk in _chunks(df.columns, CHUNK):
        aggs = [F.count(F.lit(1)).alias("rows"), *[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(chunk)]]
        items = [(c, [F.col(f"n{i}"), F.col("rows") - F.col(f"n{i}"), F.col("rows")]) for i, c in enumerate(chunk)]
        parts.append(long_rows(df.agg(*aggs), "column_name", items, ["non_null", "missing", "rows"]))
    return _union(parts)


def column_checks(df: DataFrame) -> DataFrame:
    """Per column: ``(column_name, non_null, missing, rows, is_constant)``.

    ``is_constant`` follows ``nunique() <= 1`` with missing values excluded, so an
    all-missing column is constant too.  The smallest and largest ``xxhash64`` of a
    column come from a hash aggregate (no string is kept); where they differ the column
    isn't constant, and only the few others need the true extremes."""
    df = nan_to_null(df)
    fields = df.schema.fields
    parts, rows = [], []
    for chunk in _chunks(fields, CHUNK):
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(chunk):
            h = F.when(qcol(f.name).isNotNull(), F.xxhash64(orderable(f)))
            aggs += [F.count(qcol(f.name)).alias(f"n{i}"), F.min(h).alias(f"a{i}"), F.max(h).alias(f"b{i}")]
        parts.append((chunk, df.agg(*aggs).first()))
    found = {f.name: (r[f"n{i}"], r["rows"], r[f"a{i}"] == r[f"b{i}"]) for chunk, r in parts for i, f in enumerate(chunk)}
    doubtful = [f for f in fields if found[f.name][0] and found[f.name][2]]
    same = {}
    for chunk in _chunks(doubtful, CHUNK) if doubtful else []:
        r = df.agg(*[(F.min(orderable(f)) == F.max(orderable(f))).alias(f"k{i}") for i, f in enumerate(chunk)]).first()
        same.update({f.name: bool(r[f"k{i}"]) for i, f in enumerate(chunk)})
    for f in fields:
        n, total, _ = found[f.name]
        rows.append((f.name, n, total - n, total, not n or same.get(f.name, False)))
    return df.sparkSession.createDataFrame(rows, "column_name string, non_null long, missing long, rows long, is_constant boolean")


def missing(df: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """``(column_name, missing, missing_pct)``; NaN counts as missing."""
    return (_counts(nan_to_null(df)) if checks is None else checks).select(
        "column_name", "missing", F.try_divide(F.col("missing") * 100.0, F.col("rows")).alias("missing_pct"))


def missing_summary(df: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """A4 totals: ``(total_missing, columns_with_missing)``."""
    return missing(df, checks).agg(F.sum("missing").cast("long").alias("total_missing"),
                           F.count_if(F.col("missing") > 0).cast("long").alias("columns_with_missing"))


def missing_ranked(df: DataFrame, ascending: bool = True, top: int | None = None,
                   only_present: bool = True, checks: DataFrame | None = None) -> DataFrame:
    """Missing counts ranked.  Ascending with ``> 0`` only for
    the quality chart; descending top 20 for the fallback chart.
    ``(column_name, missing, rank)`` -- a k-row table, so the global window is
    over column metadata, not data."""
    from pyspark.sql import Window
    m = missing(df, checks).select("column_name", "missing")
    if only_present:
        m = m.where(F.col("missing") > 0)
    order = [F.col("missing").asc() if ascending else F.col("missing").desc(), F.col("column_name").asc()]
    ranked = m.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where(F.col("rank") <= top) if top else ranked


def duplicates(df: DataFrame) -> DataFrame:
    """A5: ``(rows, duplicates, duplicate_pct)``, duplicates = rows - distinct rows.

    NULL = NULL and NaN = NaN, as in pandas ``duplicated``.  Rows are grouped by two
    independent 64-bit hashes of the whole row, map-side combined, so long texts never
    reach the shuffle; two rows of n share both by chance with n^2 / 2^129."""
    df = nan_to_null(df)
    whole = [orderable(f) for f in df.schema.fields]
    null = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in whole])
    groups = df.groupBy(F.xxhash64(*whole, null).alias("g0"), F.xxhash64(F.lit("second"), *reversed(whole), null).alias("g1")) \
        .agg(F.count(F.lit(1)).alias("cnt"))
    return groups.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("rows"),
                      F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("duplicates")) \
        .select("rows", "duplicates", F.try_divide(F.col("duplicates") * 100.0, F.col("rows")).alias("duplicate_pct"))


def constant_columns(df: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """``(column_name)`` of columns with at most one distinct non-missing value."""
    return (column_checks(df) if checks is None else checks).where("is_constant").select("column_name")


# Fixed values that must equal the reference's: quality score weights.
# score = clip(100 - 2 * mean(missing % per column) - 5 * duplicate %, 0, 100)
MISSING_WEIGHT = 2.0
DUPLICATE_WEIGHT = 5.0


def quality_score(df: DataFrame, checks: DataFrame | None = None, dups: DataFrame | None = None) -> DataFrame:
    """One row ``(avg_missing_pct, duplicate_pct, quality_score, remainder)``.

    An empty table (0 rows, or no column) scores 100."""
    m = missing(df, checks).agg(F.avg("missing_pct").alias("a"), F.lit(None).cast("double").alias("d"))
    d = (duplicates(df) if dups is None else dups).select(F.lit(None).cast("double").alias("a"), F.col("duplicate_pct").alias("d"))
    # two one-row results folded into one row without a join
    both = m.unionByName(d).agg(F.max("a").alias("avg_missing_pct"), F.max("d").alias("duplicate_pct"))
    raw = (F.lit(100.0) - MISSING_WEIGHT * F.col("avg_missing_pct") - DUPLICATE_WEIGHT * F.col("duplicate_pct"))
    score = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), F.lit(100.0))
    return (both.select("avg_missing_pct", "duplicate_pct", score.alias("quality_score"))
            .withColumn("remainder", 100.0 - F.col("quality_score")))


def issue_bars(df: DataFrame, checks: DataFrame | None = None, dups: DataFrame | None = None) -> DataFrame:
    """``(issue, value)`` rows ``duplicates`` and ``constant_columns``."""
    d = (duplicates(df) if dups is None else dups).select(F.col("duplicates").cast("long").alias("v"))
    k = (column_checks(df) if checks is None else checks).agg(F.count_if("is_constant").cast("long").alias("v"))
    return (d.select(F.lit("duplicates").alias("issue"), F.col("v").alias("value"))
            .unionByName(k.select(F.lit("constant_columns").alias("issue"), F.col("v").alias("value"))))


def missing_matrix(df: DataFrame, buckets: int = 50, key_cols: list[str] | None = None) -> DataFrame:
    """C5 re-aimed to a bounded size: rows are dealt by md5 into ``buckets`` groups
    (by ``key_cols`` or the whole row) and each (bucket, column) cell holds the
    missing rate.  ``(bucket, column_name, missing_rate)``."""
    df = nan_to_null(df)
    key = F.concat_ws("|", *[qcol(c).cast("string") for c in (key_cols or df.columns)])
    b = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets
    aggs = [F.avg(F.when(qcol(c).isNull(), 1.0).otherwise(0.0)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    per = df.groupBy(b.alias("bucket")).agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_rate"))
               for i, c in enumerate(df.columns)]
    return per.select("bucket", F.inline(F.array(*structs)))


def missing_patterns(df: DataFrame) -> DataFrame:
    """D-a: ``(pattern, rows)`` where the pattern has one character per column,
    ``1`` = missing, in column order."""
    df = normalize(df)
    bits = F.concat(*[F.when(qcol(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """D-h: ``(column_a, column_b)``: every column equal in all rows (NULL matching NULL)
    to an earlier one, with the first column of its group.

    Candidates agree on type, count and an order-free checksum (sum, min and max of the
    values' hashes), from one pass of hash aggregates in chunks of columns.  Each candidate
    is then compared with the first column of its group alone, so the checks grow with the
    columns and not with their pairs; any that differ form a group of their own and are
    compared again."""
    df = nan_to_null(df)
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))]
    place = {f.name: i for i, f in enumerate(fields)}
    groups: dict = {}
    for chunk in _chunks(fields, CHUNK) if fields else []:
        aggs = []
        for i, f in enumerate(chunk):
            h = F.when(qcol(f.name).isNotNull(), F.xxhash64(qcol(f.name)))
            aggs += [F.count(h).alias(f"n{i}"), F.sum(h.cast("decimal(38,0)")).alias(f"s{i}"),
                     F.min(h).alias(f"a{i}"), F.max(h).alias(f"b{i}")]
        sig = df.agg(*aggs).first()
        for i, f in enumerate(chunk):
            key = (f.dataType.simpleString(), *[sig[f"{k}{i}"] for k in "nsab"])
            groups.setdefault(key, []).append(f.name)
    found, open_groups = [], [g for g in groups.values() if len(g) > 1]
    while open_groups:
        checks = [(g[0], c) for g in open_groups for c in g[1:]]
        differ = set()
        for chunk in _chunks(checks, CHUNK):
            r = df.agg(*[F.max(~qcol(a).eqNullSafe(qcol(c))).alias(f"d{i}") for i, (a, c) in enumerate(chunk)]).first()
            differ |= {c for i, (_, c) in enumerate(chunk) if r[f"d{i}"]}
        found += [(a, c) for a, c in checks if c not in differ]
        rest = [[c for c in g[1:] if c in differ] for g in open_groups]
        open_groups = [g for g in rest if len(g) > 1]
    found.sort(key=lambda p: place[p[1]])
    return df.sparkSession.createDataFrame(found, "column_a string, column_b string")
