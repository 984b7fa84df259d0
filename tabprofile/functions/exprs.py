"""Scalar and aggregate expressions shared by the operators.

All of them are plain ``pyspark.sql.functions`` compositions: they stay
inside whole-stage codegen and need no Python at run time.  The session is
assumed to run in ANSI mode, so every division goes through ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results:
# correlation strength thresholds (on |r|) and their labels, checked in this order
#   0.8 very_strong, 0.6 strong, 0.4 moderate, 0.2 weak, otherwise very_weak
# class balance thresholds (on min_count / max_count), strict comparisons
#   > 0.8 balanced, > 0.5 moderately_imbalanced, otherwise highly_imbalanced
CORR_STRENGTH = ((0.8, "very_strong"), (0.6, "strong"), (0.4, "moderate"), (0.2, "weak"))
CORR_WEAKEST = "very_weak"
BALANCE = ((0.8, "balanced"), (0.5, "moderately_imbalanced"))
BALANCE_WORST = "highly_imbalanced"


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over pairwise-complete rows; NULL for a constant side.

    ``corr`` itself raises DIVIDE_BY_ZERO under ANSI when one side is
    constant, so r is assembled from population moments over the rows where
    both sides are present.
    """
    xm = F.when(y.isNotNull(), x)
    ym = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym))


def skewness_unbiased(x: Column) -> Column:
    """Adjusted Fisher-Pearson skewness G1 (what pandas ``skew`` reports).

    NULL below 3 values, 0 for a constant column."""
    n = F.count(x)
    g1 = F.skewness(x)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.min(x) == F.max(x), F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def kurtosis_unbiased(x: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (what pandas ``kurtosis`` reports).

    NULL below 4 values, 0 for a constant column."""
    n = F.count(x)
    g2 = F.kurtosis(x)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.min(x) == F.max(x), F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def corr_strength(r: Column) -> Column:
    a = F.abs(r)
    out = None
    for thr, label in CORR_STRENGTH:
        out = F.when(a >= thr, label) if out is None else out.when(a >= thr, label)
    # NULL r (constant side) compares false everywhere and lands on the weakest label,
    # as NaN does in the reference.
    return out.otherwise(CORR_WEAKEST)


def balance_label(ratio: Column) -> Column:
    (t1, l1), (t2, l2) = BALANCE
    return F.when(ratio > t1, l1).when(ratio > t2, l2).otherwise(BALANCE_WORST)


def long_rows(row_df: DataFrame, key: str, items: list[tuple[str, list[Column]]],
              names: list[str]) -> DataFrame:
    """Turn a wide one-row aggregate into a long table with one row per item.

    ``items`` is ``[(key_value, [col expr per name]), ...]``.  The input has one
    row, so the explode is constant work regardless of data size.
    """
    structs = [F.struct(F.lit(k).alias(key), *[c.alias(n) for c, n in zip(cols, names)])
               for k, cols in items]
    return row_df.select(F.inline(F.array(*structs)))
