"""Categorical operators.

All categorical columns are folded into one ``(column_name, value)`` stream
and counted in one grouping.  The partial aggregate runs before the shuffle,
so a value that fills a third of the table ships one row per task.  Top-k
per column uses ``row_number() <= k``; Spark inserts a partial
window-group limit below the shuffle, so each task sends at most k rows per
column to the final ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.roles import ColumnRoles, qcol


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column_name, value, count)`` for every non-missing value of every
    categorical column (values as strings)."""
    cols = ColumnRoles.of(df).categorical if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, count long")
    members = [F.struct(F.lit(c).alias("column_name"), qcol(c).cast("string").alias("value")) for c in cols]
    # inline + where (not a filter lambda) keeps the generator in codegen
    long = df.select(F.inline(F.array(*members))).where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10,
               counts: DataFrame | None = None) -> DataFrame:
    """``(column_name, rank, value, count)``, top ``k`` values per
    column by count, ties broken by the smaller value (D3)."""
    vc = value_counts(df, cols) if counts is None else counts
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    return (vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column_name", "rank", "value", "count"))


def category_stats(df: DataFrame, cols: list[str] | None = None,
                   counts: DataFrame | None = None) -> DataFrame:
    """``(column_name, unique_count, missing_count, most_common,
    most_common_count, least_common, least_common_count)``.

    most common = highest count, ties to the smaller value; least common =
    lowest count, ties to the smaller value."""
    cols = ColumnRoles.of(df).categorical if cols is None else cols
    vc = value_counts(df, cols) if counts is None else counts
    per = vc.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.min_by(F.struct(F.col("value"), F.col("count")), F.struct(-F.col("count"), F.col("value"))).alias("mc"),
        F.min_by(F.struct(F.col("value"), F.col("count")), F.struct(F.col("count"), F.col("value"))).alias("lc"))
    miss = _missing_long(df, cols)
    return (miss.join(per, "column_name", "left")
            .select("column_name", F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
                    "missing_count",
                    F.col("mc.value").alias("most_common"), F.col("mc.count").alias("most_common_count"),
                    F.col("lc.value").alias("least_common"), F.col("lc.count").alias("least_common_count")))


def _missing_long(df, cols):
    from tabprofile.functions.exprs import long_rows
    row = df.agg(*[(F.count(F.lit(1)) - F.count(qcol(c))).alias(f"m{i}") for i, c in enumerate(cols)])
    return long_rows(row, "column_name", [(c, [F.col(f"m{i}")]) for i, c in enumerate(cols)], ["missing_count"])


def distinct_count(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """``(column_name, distinct)`` ignoring missing.  Exact by default (one
    grouping over the folded value stream); ``approx=True`` uses HyperLogLog++
    with fixed-size state."""
    from tabprofile.functions.exprs import long_rows
    if approx:
        row = df.agg(*[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(cols)])
        return long_rows(row, "column_name", [(c, [F.col(f"d{i}").cast("long")]) for i, c in enumerate(cols)],
                         ["distinct"])
    members = [F.struct(F.lit(i).alias("i"), qcol(c).cast("string").alias("v")) for i, c in enumerate(cols)]
    long = df.select(F.inline(F.array(*members))).where(F.col("v").isNotNull())
    d = long.groupBy("i", "v").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count(F.lit(1)).alias("distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, column_name string")
    return (F.broadcast(names).join(d, "i", "left")  # names: one row per column
            .select("column_name", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct")))


def bounded_distinct(df: DataFrame, col: str, limit: int) -> int:
    """Number of distinct non-missing values of ``col``, counted up to
    ``limit + 1`` -- enough to decide tests like ``nunique < 20`` without
    building the full distinct set."""
    return df.select(qcol(col)).where(qcol(col).isNotNull()).distinct().limit(limit + 1).count()


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table ``(a_value, b_value, count)``; rows with a
    missing side are dropped (pandas ``crosstab``)."""
    return (df.where(qcol(a).isNotNull() & qcol(b).isNotNull())
            .groupBy(qcol(a).cast("string").alias("a_value"), qcol(b).cast("string").alias("b_value"))
            .agg(F.count(F.lit(1)).alias("count")))


def crosstab_wide(df: DataFrame, a: str, b: str, max_columns: int | None = None) -> DataFrame:
    """A17 wide form: one row per ``a`` value, one column per ``b`` value (missing cells 0).
    The levels become columns, so the driver holds them; ``max_columns`` can bound that."""
    names = df.select(qcol(b).cast("string")).where(qcol(b).isNotNull()).distinct()
    levels = [r[0] for r in (names if max_columns is None else names.limit(max_columns + 1)).collect()]
    if max_columns is not None and len(levels) > max_columns:
        raise ValueError(f"{b} has more than {max_columns} levels; use crosstab() (long form)")
    t = crosstab(df, a, b)
    return t.groupBy("a_value").pivot("b_value", sorted(levels)).agg(F.first("count")).na.fill(0)


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square of the contingency table of ``a`` x ``b``.

    One row ``(chi2, dof, n, yates)``.  Expected counts ``e = row * col / n``
    come from the marginals (joined back by level, so every level table stays
    distributed).  Cells never observed still count: their expected counts
    sum to ``n - sum of e over observed cells``, so no grid of all cells is
    built.  With one degree of freedom (a 2x2 table) Yates' correction
    applies: each ``|o - e|`` shrinks by ``min(0.5, |o - e|)``; that table has
    four cells by the level check, so its cells are addressed directly."""
    t = crosstab(df, a, b)
    dims = t.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.countDistinct("a_value").alias("r"),
                 F.countDistinct("b_value").alias("c")).first()  # three numbers
    n, r, c = dims["n"], dims["r"], dims["c"]
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([(None, 0, 0, False)], "chi2 double, dof long, n long, yates boolean")
    if r == 2 and c == 2:
        return _chi_square_2x2(t, n)
    ra = t.groupBy("a_value").agg(F.sum("count").alias("ra"))
    cb = t.groupBy("b_value").agg(F.sum("count").alias("cb"))
    e = F.col("ra") * F.col("cb") / F.lit(float(n))
    cells = t.join(ra, "a_value").join(cb, "b_value").withColumn("e", e)
    return cells.agg(
        (F.sum(F.pow(F.col("count") - F.col("e"), 2) / F.col("e")) + (F.lit(float(n)) - F.sum("e"))).alias("chi2")
    ).select("chi2", F.lit((r - 1) * (c - 1)).cast("long").alias("dof"), F.lit(n).cast("long").alias("n"),
             F.lit(False).alias("yates"))


def _chi_square_2x2(t: DataFrame, n: int) -> DataFrame:
    levels = t.agg(F.min("a_value"), F.max("a_value"), F.min("b_value"), F.max("b_value")).first()
    a1, a2, b1, b2 = levels
    o = {}
    aggs = []
    for i, av in enumerate((a1, a2)):
        for j, bv in enumerate((b1, b2)):
            aggs.append(F.coalesce(F.sum(F.when((F.col("a_value") == av) & (F.col("b_value") == bv),
                                                F.col("count"))), F.lit(0)).cast("double").alias(f"o{i}{j}"))
    row = t.agg(*aggs)
    for i in range(2):
        for j in range(2):
            o[i, j] = F.col(f"o{i}{j}")
    ra = [o[i, 0] + o[i, 1] for i in range(2)]
    cb = [o[0, j] + o[1, j] for j in range(2)]
    terms = []
    for i in range(2):
        for j in range(2):
            e = ra[i] * cb[j] / F.lit(float(n))
            d = F.abs(o[i, j] - e)
            terms.append(F.pow(d - F.least(F.lit(0.5), d), 2) / e)
    chi2 = terms[0] + terms[1] + terms[2] + terms[3]
    return row.select(chi2.alias("chi2"), F.lit(1).cast("long").alias("dof"), F.lit(n).cast("long").alias("n"),
                      F.lit(True).alias("yates"))
