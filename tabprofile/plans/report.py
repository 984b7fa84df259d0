"""Report tables (R1-R3, R5, R6): small long tables built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.operators import quality, stats
from tabprofile.operators.insights import insights
from tabprofile.roles import ColumnRoles


def summary_table(df: DataFrame, checks: DataFrame | None = None, dups: DataFrame | None = None) -> DataFrame:
    """``(metric, value)`` rows rows, columns, memory_mb, quality_score,
    total_missing, duplicates.  The column checks and the duplicate grouping
    run once; the rows are one-row results stacked by union."""
    checks = stats.materialize(quality.column_checks(df)) if checks is None else checks
    dups = stats.materialize(quality.duplicates(df)) if dups is None else dups
    parts = [
        dups.select(F.lit("rows").alias("metric"), F.col("rows").cast("double").alias("value")),
        dups.select(F.lit("columns").alias("metric"), F.lit(float(len(df.columns))).alias("value")),
        stats.memory_mb(df).select(F.lit("memory_mb").alias("metric"), F.col("memory_mb").alias("value")),
        quality.quality_score(df, checks, dups).select(F.lit("quality_score").alias("metric"),
                                                       F.col("quality_score").alias("value")),
        quality.missing_summary(df, checks).select(F.lit("total_missing").alias("metric"),
                                                   F.col("total_missing").cast("double").alias("value")),
        dups.select(F.lit("duplicates").alias("metric"), F.col("duplicates").cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_table(df: DataFrame, moments: DataFrame | None = None, quarts: DataFrame | None = None) -> DataFrame:
    """R2: describe + skewness + kurtosis per numeric column (moments once)."""
    from tabprofile.roles import normalize
    df = normalize(df)
    from tabprofile.functions.moments import column_facts
    num = ColumnRoles.of(df).numeric
    facts = column_facts(df, num) if moments is None or quarts is None else None
    m = stats.numeric_moments(df, num, facts) if moments is None else moments
    d = stats.describe(df, num, m, stats.quartiles(df, num, facts) if quarts is None else quarts)
    return d.join(F.broadcast(m.select("column_name", "skewness", "kurtosis")), "column_name")  # one row per column


def insight_table(df: DataFrame, target: str | None = None, checks: DataFrame | None = None,
                  dups: DataFrame | None = None) -> DataFrame:
    """``(category, insight)``."""
    return insights(df, target, checks, dups).select("category", "insight")


def manifest(raw: DataFrame, cleaned: DataFrame, steps: list[str], target: str | None,
             outputs: dict | None = None, flags: dict | None = None) -> DataFrame:
    """One row: raw and cleaned shape, target, ordered cleaning steps,
    outputs and flags.  The shapes are counted by Spark; the rest is metadata."""
    r = raw.agg(F.count(F.lit(1)).alias("n")).select(F.array(F.col("n"), F.lit(len(raw.columns)).cast("long"))
                                                      .alias("raw_shape"), F.lit(None).cast("array<long>").alias("cleaned_shape"))
    c = cleaned.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("array<long>").alias("raw_shape"),
                                                          F.array(F.col("n"), F.lit(len(cleaned.columns)).cast("long"))
                                                          .alias("cleaned_shape"))
    one = r.unionByName(c).agg(F.max("raw_shape").alias("raw_shape"), F.max("cleaned_shape").alias("cleaned_shape"))
    outs = F.create_map(*[x for k, v in (outputs or {}).items() for x in (F.lit(k), F.lit(str(v)))]) \
        if outputs else F.create_map().cast("map<string,string>")
    fl = F.create_map(*[x for k, v in (flags or {}).items() for x in (F.lit(k), F.lit(str(v)))]) \
        if flags else F.create_map().cast("map<string,string>")
    return one.select("raw_shape", "cleaned_shape", F.lit(target).cast("string").alias("target_column"),
                      outs.alias("outputs"), F.array(*[F.lit(s) for s in steps]).cast("array<string>").alias("cleaning_steps"),
                      fl.alias("flags"))


def role_summary(df: DataFrame) -> dict:
    r = ColumnRoles.of(df)
    return {"total": len(r.columns), "numerical": len(r.numeric), "categorical": len(r.categorical),
            "datetime": len(r.datetime)}
