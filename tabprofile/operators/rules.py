"""Validation rules (D-i): range, format and business rules as boolean
expressions, all counted in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.roles import qcol


def range_rule(col: str, lo=None, hi=None) -> Column:
    """Passes when the value is missing or inside ``[lo, hi]``."""
    c = qcol(col)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (c >= lo)
    if hi is not None:
        ok = ok & (c <= hi)
    return c.isNull() | ok


def format_rule(col: str, pattern: str) -> Column:
    """Passes when the value is missing or fully matches the regex."""
    c = qcol(col)
    return c.isNull() | c.cast("string").rlike(rf"\A(?:{pattern})\z")


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, checked, violations, violation_pct)`` for every named rule
    (a rule is a boolean expression that is true for valid rows; NULL counts
    as a violation)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (name, expr) in enumerate(rules.items()):
        aggs.append(F.count_if(~F.coalesce(expr, F.lit(False))).alias(f"v{i}"))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(name).alias("rule"), F.col("n").alias("checked"), F.col(f"v{i}").alias("violations"))
               for i, name in enumerate(rules)]
    return (row.select(F.inline(F.array(*structs)))
            .withColumn("violation_pct", F.try_divide(F.col("violations") * 100.0, F.col("checked"))))
