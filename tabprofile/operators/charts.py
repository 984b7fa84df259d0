"""The numbers behind the reference's charts (C1-C18); drawing is not built.

Histograms of any number of columns are one grouping on computed bin indices
(the 30-bin grid is a fixed-size table).  The density curve is an exact
Gaussian kernel sum: 100 sums, one a grid point, in chunked aggregates, so
no row is copied and every task sends one row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.roles import ColumnRoles, normalize, qcol
from tabprofile.sources.readers import as_number

BINS = 30
KDE_POINTS = 100
KDE_CHUNK = 50  # sums a pass, for methods the JIT takes


def _range(df: DataFrame, col: str):
    x = qcol(col).cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"),
               F.stddev_samp(x).alias("sd"), F.avg(x).alias("mean")).first()
    return r["lo"], r["hi"], r["n"], r["sd"], r["mean"]


HISTOGRAM = "bin int, bin_start double, bin_end double, count long, density double"


def _bin(x, lo: float, hi: float, bins: int):
    """The bin of a value as NumPy finds it: computed, then corrected by the real edges."""
    step = (hi - lo) / bins

    def edge(i):
        return F.when(i == bins, F.lit(hi)).otherwise(i * F.lit(step) + F.lit(lo))
    i = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)).cast("int"), F.lit(bins - 1))
    # least() skips NULL, so a missing value must not come so far
    return F.when(x.isNotNull(), F.when(x < edge(i), i - 1).when((x >= edge(i + 1)) & (i < bins - 1), i + 1).otherwise(i))


def histograms(df: DataFrame, cols: list[str], bins: int = BINS) -> DataFrame:
    """``(column_name, bin, bin_start, bin_end, count, density)`` of all columns:
    one pass for the ranges, one for the counts.  ``bins`` equal-width bins over
    ``[min, max]``, the last closed on the right; a single-valued column uses
    ``[v - 0.5, v + 0.5]``; infinities have no bin; a column without values no rows."""
    from tabprofile.functions.moments import column_facts
    from tabprofile.operators.stats import _chunks
    spark = df.sparkSession
    finite = normalize(df.select(*[qcol(c) for c in cols]))
    finite = finite.select(*[F.when(F.abs(qcol(c)) < float("inf"), qcol(c).cast("double")).alias(c) for c in cols])
    facts = column_facts(finite, cols)
    ranges = {c: (facts.min[c], facts.max[c]) for c in cols if facts.count[c]}
    ranges = {c: (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for c, (lo, hi) in ranges.items()}
    if not ranges:
        return spark.createDataFrame([], "column_name string, " + HISTOGRAM)
    parts = None
    for chunk in _chunks(list(ranges), 40):
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _bin(qcol(c), *ranges[c], bins).alias("bin")) for c in chunk])
        part = finite.select(F.inline(cells)).where(F.col("bin").isNotNull()).groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("c"))
        parts = part if parts is None else parts.unionByName(part)
    meta = spark.createDataFrame([(c, float(lo), float(hi), facts.count[c]) for c, (lo, hi) in ranges.items()],
                                 "column_name string, lo double, hi double, n long")
    grid = meta.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))  # bins rows a column
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return grid.join(parts, ["column_name", "bin"], "left").select(
        "column_name", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("c", F.lit(0)).cast("long").alias("count"), (F.coalesce("c", F.lit(0)) / (F.col("n") * width)).alias("density"))


def histogram(df: DataFrame, col: str, bins: int = BINS, coerce: bool = False) -> DataFrame:
    """:func:`histograms` of one column, without its name.  With ``coerce``
    non-numeric text becomes missing first."""
    if coerce:
        df = df.select(as_number(df, col).alias(col))
    return histograms(df, [col], bins).drop("column_name")


def kde(df: DataFrame, col: str, points: int = KDE_POINTS, bins: int | None = None) -> DataFrame:
    """Gaussian kernel density on ``points`` evenly spaced points over
    ``[min, max]`` with Scott's bandwidth ``h = std * n^(-1/5)``.
    ``(point, x, density)``; empty when fewer than two values or no spread.  Infinite values
    are left out, as in the histograms.

    Exact by default: every value meets every grid point, as 100 sums.  With ``bins``
    the values are first counted into ``bins`` equal-width bins (one grouping)
    and the kernel runs over the bin centres weighted by their counts: work
    after the grouping no longer grows with the rows, and each value moves at
    most half a bin width, which bounds the error by ``width / (2h)`` of the
    kernel's slope."""
    spark = df.sparkSession
    df = normalize(df.select(qcol(col)))
    df = df.where(F.abs(qcol(col).cast("double")) < float("inf"))
    lo, hi, n, sd, _ = _range(df, col)
    if not n or n < 2 or not sd:
        return spark.createDataFrame([], "point int, x double, density double")
    h = sd * n ** (-0.2)
    step = (hi - lo) / (points - 1)
    x = qcol(col).cast("double")
    g = F.lit(lo) + F.col("point") * F.lit(step)
    if bins:
        w = (hi - lo) / bins
        b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)).cast("int"), F.lit(bins - 1))
        centres = (df.where(x.isNotNull()).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
                   .select((F.lit(lo) + (F.col("b") + 0.5) * F.lit(w)).alias("v"), "c"))
        contrib = (centres.select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
                   .select("point", (F.col("c") * F.exp(F.lit(-0.5) * F.pow((g - F.col("v")) / F.lit(h), 2))).alias("k")))
        norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
        return (contrib.groupBy("point").agg(F.sum("k").alias("s"))
                .select("point", g.alias("x"), (F.col("s") * F.lit(norm)).alias("density")))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    out = None
    for first in range(0, points, KDE_CHUNK):
        at = {p: lo + p * step for p in range(first, min(points, first + KDE_CHUNK))}
        sums = df.agg(*[F.sum(F.exp(F.lit(-0.5) * F.pow((F.lit(v) - x) / F.lit(h), 2))).alias(f"s{p}") for p, v in at.items()])
        part = sums.select(F.inline(F.array(*[F.struct(F.lit(p).alias("point"), F.lit(v).alias("x"),
                                                       (F.col(f"s{p}") * F.lit(norm)).alias("density")) for p, v in at.items()])))
        out = part if out is None else out.unionByName(part)
    return out


def distribution_markers(df: DataFrame, col: str) -> DataFrame:
    """C9 / C15 markers: ``(mean, median, std, min, max)`` of one column."""
    from tabprofile.operators.stats import distribution
    return distribution(df, [col]).select("mean", "median", "std", "min", "max")


def first_numeric_histogram(df: DataFrame, bins: int = BINS) -> DataFrame:
    """C17 fallback chart: the first numeric column, coerced, ``bins`` bins (frequencies)."""
    num = ColumnRoles.of(df).numeric
    if not num:
        return df.sparkSession.createDataFrame(
            [], "column_name string, bin int, bin_start double, bin_end double, count long")
    h = histogram(df, num[0], bins, coerce=True)
    return h.select(F.lit(num[0]).alias("column_name"), "bin", "bin_start", "bin_end", "count")


def dtype_shares(df: DataFrame) -> DataFrame:
    """C1 pie: data type shares (schema only)."""
    from tabprofile.operators.stats import type_counts
    return type_counts(df)


class ChartTables(Mapping):
    """Chart tables by name; each is computed when it is first asked for, and kept."""

    def __init__(self, makers: dict):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self):
        return len(self._makers)


def chart_data(df: DataFrame, target: str | None = None, shared: dict | None = None) -> ChartTables:
    """All chart tables, each computed only when it is asked for (:class:`ChartTables`).
    Sections without data are left out.  ``shared`` takes a profile's pinned results
    (checks, dups, counts, pairs, pca), which then aren't computed again."""
    from tabprofile.operators import categorical, multivariate, quality, relate, stats
    shared = shared or {}
    checks, dups = shared.get("checks"), shared.get("dups")
    roles = ColumnRoles.of(df)
    num = roles.numeric

    @lru_cache
    def pairs():
        return shared["pairs"] if shared.get("pairs") is not None else relate.correlation_pairs(df, num)

    out = {"dtype_shares": lambda: stats.type_counts(df), "role_counts": lambda: stats.role_counts(df),
           "missing_pct": lambda: quality.missing(df, checks), "quality_share": lambda: quality.quality_score(df, checks, dups),
           "issues": lambda: quality.issue_bars(df, checks, dups), "missing_matrix": lambda: quality.missing_matrix(df),
           "missing_counts": lambda: quality.missing_ranked(df, ascending=True, checks=checks)}
    if num:
        out["histograms"] = lambda: histograms(df, num)  # every numeric column, one pass
    out |= {f"kde:{c}": lambda c=c: kde(df, c) for c in num}
    if roles.categorical:
        out["top_values"] = lambda: categorical.top_values(df, roles.categorical, counts=shared.get("counts"))
    if len(num) > 1:
        out["corr_heatmap"] = lambda: pairs().select(F.col("feature2").alias("row_feature"), F.col("feature1").alias("col_feature"), "correlation")
        out["top_correlations"] = lambda: relate.top_correlations_chart(pairs())
    if len(num) > 2:
        out["pca"] = lambda: shared["pca"] if shared.get("pca") is not None else multivariate.pca_variance(df, num)
        out["pca_lines"] = lambda: multivariate.scree_lines(out["pca"]())
    if target and target in df.columns:
        from tabprofile.operators.target import class_counts, is_class_target
        if is_class_target(df, target):
            out["target_classes"] = lambda: class_counts(df, target)
        else:
            out["target_histogram"] = lambda: histogram(df, target)
            if roles.roles.get(target) == "numeric":
                out["importance"] = lambda: relate.feature_importance(df, target)
    return ChartTables(out)
