"""Target-column operators.

Target resolution works on column *names* only (driver-side, no data pass);
class counts are one grouping on the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.functions.exprs import balance_label
from tabprofile.operators import stats
from tabprofile.operators.categorical import bounded_distinct
from tabprofile.operators.quality import has_map
from tabprofile.roles import ColumnRoles, normalize, qcol
from tabprofile.sources.readers import as_number


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``(class, count)`` of the non-missing target values."""
    return (df.where(qcol(target).isNotNull())
            .groupBy(qcol(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count")))


def class_balance(df: DataFrame, target: str, counts: DataFrame | None = None) -> DataFrame:
    """``(n_classes, min_count, max_count, ratio, balance)``."""
    cc = class_counts(df, target) if counts is None else counts
    b = cc.agg(F.count(F.lit(1)).alias("n_classes"), F.min("count").alias("min_count"),
               F.max("count").alias("max_count"))
    ratio = F.try_divide(F.col("min_count").cast("double"), F.col("max_count"))
    return b.select(F.col("n_classes").cast("long").alias("n_classes"), "min_count", "max_count",
                    ratio.alias("ratio"), balance_label(ratio).alias("balance"))


def is_class_target(df: DataFrame, target: str) -> bool:
    """The profile's rule: string (object) targets are classes, and boolean
    targets too (D9); numeric targets, 0/1 included, are regression here."""
    return ColumnRoles.of(df).roles.get(target) in ("categorical", "boolean")


def target_profile(df: DataFrame, target: str, moments: DataFrame | None = None,
                   quarts: DataFrame | None = None) -> DataFrame:
    """One row describing the target.  ``type`` is ``classification`` or
    ``regression``; class fields or distribution/outlier fields are NULL when
    they do not apply.  An unknown column raises."""
    if target not in df.columns:
        raise ValueError("Target column not found")
    df = normalize(df)
    miss = df.agg((F.count(F.lit(1)) - F.count(qcol(target))).alias("missing_count"))
    null_d = F.lit(None).cast("double")
    if is_class_target(df, target):
        b = class_balance(df, target)
        # two one-row results folded together without a join
        u = (miss.select("missing_count", F.lit(None).cast("long").alias("n_classes"),
                         F.lit(None).cast("string").alias("balance"))
             .unionByName(b.select(F.lit(None).cast("long").alias("missing_count"), "n_classes", "balance")))
        one = u.agg(F.max("missing_count").alias("missing_count"), F.max("n_classes").alias("n_classes"),
                    F.max("balance").alias("balance"))
        return one.select(F.lit(target).alias("target"), F.lit("classification").alias("type"),
                          "missing_count", "n_classes", "balance",
                          *[null_d.alias(c) for c in ("mean", "median", "std", "min", "max", "q25", "q75", "iqr",
                                                      "skewness", "kurtosis", "outlier_percentage")],
                          F.lit(None).cast("long").alias("outlier_count"))
    m1 = None if moments is None else moments.where(F.col("column_name") == target)
    q1 = None if quarts is None else quarts.where(F.col("column_name") == target)
    d = stats.distribution(df, [target], m1, q1)
    o = stats.iqr_outliers(df, [target], quarts=q1).select("column_name", "outlier_count", "outlier_percentage")
    n_missing = miss.first()[0]  # one number
    return (d.join(F.broadcast(o), "column_name")  # one row each
            .select(F.col("column_name").alias("target"), F.lit("regression").alias("type"),
                    F.lit(n_missing).cast("long").alias("missing_count"),
                    F.lit(None).cast("long").alias("n_classes"), F.lit(None).cast("string").alias("balance"),
                    "mean", "median", "std", "min", "max", "q25", "q75", "iqr", "skewness", "kurtosis",
                    "outlier_percentage", "outlier_count"))


# Fixed values that must equal the reference's for the same target choice.
# Aliases for a requested target (after trim + lower-case), tried in this order:
TARGET_ALIASES = {
    "sales": ["net amount", "gross amount", "quantity ordered"],
    "profit": ["net amount", "gross amount"],
    "revenue": ["net amount", "gross amount"],
    "amount": ["net amount", "gross amount"],
}
# Derived sales column: quantity x price when both columns exist.
SALES_PARTS = ("quantity ordered", "price each")
# Conventional target names tried when none is given, in this order:
CONVENTIONAL_TARGETS = ["target", "label", "class", "survived", "outcome", "y"]


def _by_folded_name(columns: list[str]) -> dict[str, str]:
    # later duplicates win, as with a dict built over the columns in order
    return {c.strip().lower(): c for c in columns}


def derive_product(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``name = coalesce(number(a), 0) * coalesce(number(b), 0)``, where text that is no
    decimal number counts as missing."""
    def num(c):
        return F.coalesce(as_number(df, c), F.lit(0.0))
    return df.withColumn(name, num(a) * num(b))


def resolve_target(df: DataFrame, requested: str | None) -> tuple[DataFrame, str | None]:
    """Trimmed, case-insensitive match of the requested name; for
    ``sales`` a product column is derived from quantity x price when both
    exist; then the alias lists.  Returns the (possibly widened) frame and the
    resolved column name (the request unchanged when nothing matches)."""
    if not requested:
        return df, requested
    want = requested.strip().lower()
    if not want:
        return df, None
    for c in df.columns:  # first case-insensitive match wins
        if c.strip().lower() == want:
            return df, c
    names = _by_folded_name(df.columns)
    if want == "sales" and all(p in names for p in SALES_PARTS):
        col = "Sales"
        return derive_product(df, names[SALES_PARTS[0]], names[SALES_PARTS[1]], col), col
    for alias in TARGET_ALIASES.get(want, []):
        if alias in names:
            return df, names[alias]
    return df, requested


def choose_target(df: DataFrame, requested: str | None = None, train: bool = True,
                  min_classes: int = 2, max_classes: int = 20) -> str | None:
    """A valid requested column; without training, the request as it is; else
    the first conventional name; else the first column, in order, with ``2 <= nunique <= 20``.
    The distinct checks stop counting at ``max_classes + 1`` values."""
    if requested and requested in df.columns:
        return requested
    if not train:
        return requested
    names = _by_folded_name(df.columns)
    for cand in CONVENTIONAL_TARGETS:
        if cand in names:
            return names[cand]
    # one approximate pass discards clearly high-cardinality columns, the
    # exact bounded check confirms the survivors in column order
    # (columns that hold maps can't be counted and are no target)
    usable = [f.name for f in df.schema.fields if not has_map(f.dataType)]
    approx = df.agg(*[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(usable)]).first() if usable else {}
    for i, c in enumerate(usable):
        if approx[f"d{i}"] > 2 * max_classes:
            continue
        n = bounded_distinct(df, c, max_classes)
        if min_classes <= n <= max_classes:
            return c
    return requested


def infer_task(df: DataFrame, target: str, max_classes: int = 20) -> str:
    """M1: ``classification`` for string / boolean targets or fewer than
    ``max_classes`` distinct values, else ``regression``."""
    if ColumnRoles.of(df).roles.get(target) in ("categorical", "boolean"):
        return "classification"
    return "classification" if bounded_distinct(df, target, max_classes) < max_classes else "regression"
