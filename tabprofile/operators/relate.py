"""Relationships between columns.

Correlations: pairwise-complete Pearson r from mean-shifted sums of cross
products -- plain ``sum`` aggregates, fused in chunks (one partial row per
task, one final row).  Per-class statistics fold the features into a
``(class, feature, value)`` stream grouped by (class, feature): one shuffle
for all features, map-side combined, so a class holding a third of the
rows still ships one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.exprs import corr_strength, long_rows
from tabprofile.functions.moments import column_facts, pair_correlations
from tabprofile.roles import ColumnRoles, normalize, qcol

def correlation_pairs(df: DataFrame, cols: list[str] | None = None, facts=None) -> DataFrame:
    """B1 upper triangle: ``(i, j, feature1, feature2, correlation)`` for i < j in
    column order; NULL where a side is constant or no complete pair exists.
    Two passes of plain sums (facts, then mean-shifted cross products); the
    k(k-1)/2 results are a small table."""
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    schema = "i int, j int, feature1 string, feature2 string, correlation double"
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    facts = facts or column_facts(df, cols)
    r = pair_correlations(df, [(cols[i], cols[j]) for i, j in pairs], facts)
    return df.sparkSession.createDataFrame(
        [(i, j, cols[i], cols[j], r[(cols[i], cols[j])]) for i, j in pairs], schema)


def corr_matrix(df: DataFrame, cols: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """B1 full matrix, long: ``(feature1, feature2, correlation)`` for every
    ordered pair including the diagonal (1, or NULL for a constant column)."""
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    p = correlation_pairs(df, cols) if pairs is None else pairs
    upper = p.select("feature1", "feature2", "correlation")
    lower = p.select(F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), "correlation")
    row = df.agg(*[(F.min(qcol(c)) < F.max(qcol(c))).alias(f"v{i}") for i, c in enumerate(cols)])
    diag = long_rows(row, "feature1", [(c, [F.lit(c), F.when(F.col(f"v{i}"), F.lit(1.0))])
                                       for i, c in enumerate(cols)], ["feature2", "correlation"])
    return upper.unionByName(lower).unionByName(diag)


def corr_heatmap(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C11: strict lower triangle ``(row_feature, col_feature, correlation)``."""
    p = correlation_pairs(df, cols)
    return p.select(F.col("feature2").alias("row_feature"), F.col("feature1").alias("col_feature"), "correlation")


def high_correlations(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """B2 / K1: pairs with ``|r| > threshold`` (strict), ranked by ``|r|``
    descending: ``(rank, feature1, feature2, correlation)``.  The input has
    k(k-1)/2 rows, so the global ranking is over metadata only."""
    hp = pairs.where(F.abs("correlation") > threshold)
    w = Window.orderBy(F.abs("correlation").desc(), F.col("i"), F.col("j"))
    return hp.select(F.row_number().over(w).alias("rank"), "feature1", "feature2", "correlation")


def top_correlations_chart(pairs: DataFrame, threshold: float = 0.7, top: int = 10,
                           flag: float = 0.8) -> DataFrame:
    """Top ``top`` high pairs with a ``very_high`` flag for ``|r| > flag``."""
    return (high_correlations(pairs, threshold).where(F.col("rank") <= top)
            .withColumn("very_high", F.abs("correlation") > flag))


def avg_correlation(pairs: DataFrame) -> DataFrame:
    """B2: mean of the upper triangle; NULL when any r is NULL (NaN in pandas)."""
    return pairs.agg(F.when(F.count_if(F.col("correlation").isNull()) > 0, F.lit(None).cast("double"))
                     .otherwise(F.avg("correlation")).alias("avg_correlation"))


def feature_target_corr(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """``(feature, correlation, strength)`` of each numeric feature with a
    numeric target."""
    df = normalize(df)
    feats = [c for c in (ColumnRoles.of(df).numeric if features is None else features) if c != target]
    schema = "feature string, correlation double"
    if not feats:
        return df.sparkSession.createDataFrame([], schema + ", strength string")
    facts = column_facts(df, feats + [target])
    r = pair_correlations(df, [(f, target) for f in feats], facts)
    long = df.sparkSession.createDataFrame([(f, r[(f, target)]) for f in feats], schema)
    return long.withColumn("strength", corr_strength(F.col("correlation")))


def feature_importance(df: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """``|r|`` of every numeric feature with a numeric target,
    ranked: ``(rank, feature, importance, share, is_top)``; ``share`` is the
    percentage of the top-5 total (the top-5 chart), ``is_top`` marks the
    first five.  A non-numeric target raises."""
    roles = ColumnRoles.of(df)
    if roles.roles.get(target) != "numeric":
        raise ValueError("Target column must be numerical for feature importance")
    ft = feature_target_corr(df, target).select("feature", F.abs("correlation").alias("importance"))
    w = Window.orderBy(F.col("importance").desc_nulls_last(), F.col("feature"))  # k rows
    ranked = ft.withColumn("rank", F.row_number().over(w))
    top5 = F.sum(F.when(F.col("rank") <= 5, F.col("importance"))).over(Window.partitionBy(F.lit(0)))
    out = ranked.select("rank", "feature", "importance",
                        F.when(F.col("rank") <= 5, F.try_divide(F.col("importance") * 100.0, top5)).alias("share"),
                        (F.col("rank") <= 5).alias("is_top"))
    return out.where(F.col("rank") <= top) if top else out


GROUP_CHUNK = 12  # features per grouped pass (3 aggregates each)


def group_moments(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """``(feature, class, n, mean, std)`` per feature and target class;
    rows with a missing target dropped; missing feature values skipped.

    One hash aggregate keyed by the class with (count, avg, stddev) per
    feature: the partial aggregate runs in every task, so a class holding a
    third of the rows still ships one partial row per task."""
    df = normalize(df)
    feats = [c for c in (ColumnRoles.of(df).numeric if features is None else features) if c != target]
    if not feats:
        return df.sparkSession.createDataFrame([], "feature string, class string, n long, mean double, std double")
    d = df.where(qcol(target).isNotNull())
    parts = []
    for s0 in range(0, len(feats), GROUP_CHUNK):
        chunk = feats[s0:s0 + GROUP_CHUNK]
        aggs = []
        for i, f in enumerate(chunk):
            x = qcol(f).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        g = d.groupBy(qcol(target).cast("string").alias("class")).agg(*aggs)
        structs = [F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                            F.col(f"s{i}").alias("std")) for i, f in enumerate(chunk)]
        parts.append(g.select("class", F.inline(F.array(*structs)))
                     .select("feature", "class", "n", "mean", "std"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a class may lack values of one feature: it then does not count as a group for it
    return out.where(F.col("n") > 0)


def anova(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """One-way ANOVA F per numeric feature across target classes.

    ``(feature, groups, f_stat)``; ``F = (SSB / (g - 1)) / (SSW / (N - g))``
    from per-class (n, mean, variance).  Fewer than two groups gives 0;
    ``SSW = 0`` gives NULL.  Missing feature values are left out (D2)."""
    g = group_moments(df, target, features)
    g = g.withColumn("ss_within", F.coalesce(F.col("std") * F.col("std") * (F.col("n") - 1), F.lit(0.0)))
    tot = g.groupBy("feature").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("N"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum("ss_within").alias("ssw"))
    # between-group sum of squares against the grand mean: join the per-feature
    # totals (one row per feature) back onto the per-class rows
    ssb = (g.join(tot.select("feature", "grand"), "feature")
           .groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb")))
    f_stat = F.when(F.col("groups") < 2, F.lit(0.0)).otherwise(
        F.try_divide(F.col("ssb") / (F.col("groups") - 1), F.col("ssw") / (F.col("N") - F.col("groups"))))
    return tot.join(ssb, "feature").select("feature", F.col("groups").cast("long").alias("groups"),
                                           f_stat.alias("f_stat"))


def feature_target(df: DataFrame, target: str) -> DataFrame:
    """B6 dispatcher: a string (object) target -> numeric-vs-categorical rows
    (group means / stds / ANOVA F); any other target -> correlation rows.
    Returns ``(feature, kind, correlation, strength, f_stat)``."""
    role = ColumnRoles.of(df).roles.get(target)
    if role == "categorical":
        a = anova(df, target)
        return a.select("feature", F.lit("numerical_vs_categorical").alias("kind"),
                        F.lit(None).cast("double").alias("correlation"), F.lit(None).cast("string").alias("strength"),
                        "f_stat")
    c = feature_target_corr(df, target)
    return c.select("feature", F.lit("numerical_vs_numerical").alias("kind"), "correlation", "strength",
                    F.lit(None).cast("double").alias("f_stat"))
