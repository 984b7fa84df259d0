"""The whole profile in one call.

``profile(df, target)`` returns a :class:`Profile` holding one lazy
DataFrame per section.  The input is not copied: each job reads the columns
it needs from the source, which a columnar format makes cheap.  The shared
jobs run once and their small results (O(columns) rows) are pinned; value
counts, which can be as long as a column's distinct values, are written once to
the shared folder.  Sections that need a driver literal (quantile bounds, PCA
matrix) run their small job when the section is built.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabprofile.operators import categorical, insights, multivariate, quality, relate, stats, target as tgt
from tabprofile.functions.moments import column_facts
from tabprofile.roles import ColumnRoles, normalize
from tabprofile.sources.sinks import shared_table

SECTIONS = ("overview", "data_quality", "statistics", "univariate", "bivariate", "multivariate",
            "target_analysis", "insights")


@dataclass
class Profile:
    roles: ColumnRoles
    target: str | None
    sections: dict = field(default_factory=dict)  # section -> {name: DataFrame}
    shared: dict = field(default_factory=dict)  # results of the shared jobs, by name

    def __getitem__(self, key):
        return self.sections[key]

    def tables(self):
        for s, d in self.sections.items():
            for name, df in d.items():
                yield f"{s}.{name}", df

    def run_all(self, action, max_concurrent_jobs: int = 4) -> dict:
        """Apply ``action(name, df)`` to every section table, several Spark
        jobs at a time; returns ``{name: result}``."""
        items = list(self.tables())
        with ThreadPoolExecutor(max_workers=max_concurrent_jobs) as pool:
            futs = {name: pool.submit(action, name, df) for name, df in items}
            return {name: f.result() for name, f in futs.items()}

    def release(self):
        """Let go of the pinned results and section tables."""
        self.shared.clear()
        self.sections.clear()


def profile(df: DataFrame, target: str | None = None, *, top_k: int = 10, max_concurrent_jobs: int = 4) -> Profile:
    base = normalize(df)
    roles = ColumnRoles.of(base)
    p = Profile(roles, target)
    num, cat = roles.numeric, roles.categorical
    # The shared jobs, each run once; their small results are pinned.  They
    # are independent, so they are submitted together from driver threads and
    # Spark schedules their tasks side by side (each global aggregate ends in
    # a one-task stage; alone it would leave the other cores idle).
    with ThreadPoolExecutor(max_workers=max_concurrent_jobs) as pool:
        f_checks = pool.submit(lambda: stats.materialize(quality.column_checks(df)))      # J1: counts, constants
        f_dups = pool.submit(lambda: stats.materialize(quality.duplicates(df)))           # J6: full-row grouping
        f_facts = pool.submit(lambda: column_facts(base, num) if num else None)           # J1: count/min/max/mean
        facts = f_facts.result()
        f_quarts = pool.submit(lambda: stats.quartiles(base, num, facts) if num else None)  # J2: exact quartiles
        f_moments = pool.submit(lambda: stats.numeric_moments(base, num, facts) if num else None)  # J1: power sums
        f_pairs = pool.submit(lambda: relate.correlation_pairs(base, num, facts) if len(num) > 1 else None)  # J4
        checks, dups, quarts, moments, pairs = (f_checks.result(), f_dups.result(), f_quarts.result(),
                                                f_moments.result(), f_pairs.result())
    p.shared = {"checks": checks, "dups": dups, "quarts": quarts, "moments": moments, "pairs": pairs}
    p.sections["overview"] = {
        "shape": stats.shape(base), "types": stats.type_counts(base), "roles": stats.role_counts(base),
        "memory": stats.memory_mb(base)}
    p.sections["data_quality"] = {
        "missing": quality.missing(base, checks), "missing_summary": quality.missing_summary(base, checks),
        "duplicates": dups, "constant_columns": quality.constant_columns(base, checks),
        "quality_score": quality.quality_score(base, checks, dups)}
    st = {}
    if num:
        st["numeric"] = stats.describe(base, num, moments, quarts)
        st["moments"] = stats.skew_kurtosis(base, num, moments)
    if cat:
        # Value counts can be as long as a column's distinct values, so they
        # stay distributed, never collected
        counts = p.shared["counts"] = shared_table(categorical.value_counts(base, cat), "value-counts")
        st["categorical"] = categorical.category_stats(base, cat, counts=counts)
        st["top_values"] = categorical.top_values(base, cat, k=top_k, counts=counts)
    p.sections["statistics"] = st
    uni = {}
    if num:
        uni["distribution"] = stats.distribution(base, num, moments, quarts)
        uni["outliers"] = stats.iqr_outliers(base, num, quarts=quarts)               # J3
        uni["outlier_values"] = stats.outlier_values(base, num, quarts=quarts)
    p.sections["univariate"] = uni
    bi = {}
    has_target = bool(target) and target in base.columns
    if has_target:
        bi["feature_target"] = relate.feature_target(base, target)
        if tgt.is_class_target(base, target) and roles.roles[target] == "categorical":
            bi["group_moments"] = relate.group_moments(base, target, num)           # J7
    if pairs is not None:
        bi["correlation_pairs"] = pairs
        bi["high_correlations"] = relate.high_correlations(pairs)
        bi["avg_correlation"] = relate.avg_correlation(pairs)
    p.sections["bivariate"] = bi
    mv = {}
    if len(num) > 2:
        # From J4's pairs when no numeric cell is missing, else its own pass
        mv["pca"], mv["pca_summary"] = multivariate.pca(base, num, bi.get("correlation_pairs"), facts)
    if has_target and roles.roles.get(target) == "numeric":
        mv["feature_importance"] = relate.feature_importance(base, target)
    p.sections["multivariate"] = mv
    if target and not has_target:  # D11: an error entry in this section alone
        p.sections["target_analysis"] = {"error": df.sparkSession.createDataFrame([(target, "Target column not found")], "target string, error string")}
    elif target:
        p.sections["target_analysis"] = {"profile": tgt.target_profile(base, target, moments, quarts)}
        if tgt.is_class_target(base, target):
            p.sections["target_analysis"]["class_counts"] = tgt.class_counts(base, target)
    p.sections["insights"] = {"insights": insights.insights(base, target, checks, dups)}
    return p
