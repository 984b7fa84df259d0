"""Rule-based insights.

The rule inputs are one-row aggregates, folded into a single row without a
join; the rules are ``when`` expressions over that row, so the whole thing
is one small Spark plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.operators import quality
from tabprofile.operators.target import class_balance, is_class_target
from tabprofile.roles import ColumnRoles

# Fixed values that must equal the reference's: insight categories, texts
# and thresholds, in the reference's order.
#   data_quality_insights: "Dataset has %d missing values that need attention"   (total missing > 0)
#   data_quality_insights: "Found %d duplicate rows that should be removed"      (duplicates > 0)
#   feature_insights:      "Dataset has %d numerical features for analysis"      (any numeric column)
#   feature_insights:      "Dataset has %d categorical features for encoding"    (any categorical column)
#   recommendations:       "Consider data cleaning before analysis"              (quality score < 80)
#   recommendations:       "Consider dimensionality reduction for high-dimensional data"  (> 10 numeric)
#   recommendations:       "Target is highly imbalanced - consider resampling techniques"  (class target)
QUALITY_THRESHOLD = 80.0
HIGH_DIMENSION = 10


def insights(df: DataFrame, target: str | None = None, checks: DataFrame | None = None,
             dups: DataFrame | None = None) -> DataFrame:
    """``(seq, category, insight)`` rows in rule order.  ``checks`` /
    ``dups`` let a caller reuse :func:`quality.column_checks` and
    :func:`quality.duplicates` results."""
    roles = ColumnRoles.of(df)
    n_num, n_cat = len(roles.numeric), len(roles.categorical)
    dups = quality.duplicates(df) if dups is None else dups
    ms = quality.missing_summary(df, checks).select("total_missing", F.lit(None).cast("long").alias("dups"),
                                            F.lit(None).cast("double").alias("score"),
                                            F.lit(None).cast("string").alias("balance"))
    dp = dups.select(F.lit(None).cast("long").alias("total_missing"),
                                       F.col("duplicates").alias("dups"),
                                       F.lit(None).cast("double").alias("score"),
                                       F.lit(None).cast("string").alias("balance"))
    qs = quality.quality_score(df, checks, dups).select(F.lit(None).cast("long").alias("total_missing"),
                                          F.lit(None).cast("long").alias("dups"),
                                          F.col("quality_score").alias("score"),
                                          F.lit(None).cast("string").alias("balance"))
    parts = ms.unionByName(dp).unionByName(qs)
    if target and target in df.columns and is_class_target(df, target):
        parts = parts.unionByName(class_balance(df, target).select(
            F.lit(None).cast("long").alias("total_missing"), F.lit(None).cast("long").alias("dups"),
            F.lit(None).cast("double").alias("score"), "balance"))
    one = parts.agg(F.max("total_missing").alias("total_missing"), F.max("dups").alias("dups"),
                    F.max("score").alias("score"), F.max("balance").alias("balance"))

    def rule(seq, cat, cond, text):
        return F.when(cond, F.struct(F.lit(seq).alias("seq"), F.lit(cat).alias("category"),
                                     text.alias("insight")))

    rules = [
        rule(1, "data_quality_insights", F.col("total_missing") > 0,
             F.format_string("Dataset has %d missing values that need attention", F.col("total_missing"))),
        rule(2, "data_quality_insights", F.col("dups") > 0,
             F.format_string("Found %d duplicate rows that should be removed", F.col("dups"))),
        rule(3, "feature_insights", F.lit(n_num > 0),
             F.lit(f"Dataset has {n_num} numerical features for analysis")),
        rule(4, "feature_insights", F.lit(n_cat > 0),
             F.lit(f"Dataset has {n_cat} categorical features for encoding")),
        rule(5, "recommendations", F.col("score") < QUALITY_THRESHOLD,
             F.lit("Consider data cleaning before analysis")),
        rule(6, "recommendations", F.lit(n_num > HIGH_DIMENSION),
             F.lit("Consider dimensionality reduction for high-dimensional data")),
        rule(7, "recommendations", F.coalesce(F.col("balance") == "highly_imbalanced", F.lit(False)),
             F.lit("Target is highly imbalanced - consider resampling techniques")),
    ]
    return one.select(F.inline(F.filter(F.array(*rules), lambda e: e.isNotNull())))
