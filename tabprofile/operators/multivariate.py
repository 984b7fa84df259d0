"""Principal components of the standardised numeric columns.

The explained-variance spectrum of standardised data is the eigen-spectrum
of the correlation matrix of the complete cases.  So the data work is two
passes of plain sums over the rows where every numeric column is present
(facts, then mean-shifted cross products); the k x k matrix -- O(k^2)
numbers, independent of the row count -- is decomposed on the driver.
A constant column standardises to all zeros: its row and column of the
matrix are zero, which adds a zero eigenvalue, as in scikit-learn.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.moments import column_facts, pair_correlations
from tabprofile.roles import ColumnRoles, normalize, qcol


def spectrum_from_pairs(pairs: DataFrame, cols: list[str], n: int, constant: set) -> np.ndarray:
    """Eigenvalues from an already computed correlation table -- valid for
    the complete cases when no numeric cell is missing (then every pair is
    complete over all rows)."""
    k = len(cols)
    idx = {c: i for i, c in enumerate(cols)}
    m = np.zeros((k, k))
    for c in cols:
        m[idx[c], idx[c]] = 0.0 if c in constant else 1.0
    for r in pairs.select("feature1", "feature2", "correlation").collect():  # k(k-1)/2 rows
        v = r["correlation"]
        m[idx[r["feature1"]], idx[r["feature2"]]] = m[idx[r["feature2"]], idx[r["feature1"]]] = 0.0 if v is None else v
    return np.sort(np.linalg.eigvalsh(m))[::-1][:min(n, k)] if n else np.array([])


def pca_spectrum(df: DataFrame, cols: list[str] | None = None) -> tuple[np.ndarray, int, list[str]]:
    df = normalize(df)
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    k = len(cols)
    cc = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).na.drop("any")
    names = [f"c{i}" for i in range(k)]
    facts = column_facts(cc, names)
    n = facts.rows
    r = pair_correlations(cc, [(names[i], names[j]) for i in range(k) for j in range(i + 1, k)], facts)
    m = np.zeros((k, k))
    for i in range(k):
        m[i, i] = 0.0 if facts.constant(names[i]) else 1.0
        for j in range(i + 1, k):
            v = r[(names[i], names[j])]
            m[i, j] = m[j, i] = 0.0 if v is None else v
    eig = np.sort(np.linalg.eigvalsh(m))[::-1] if n else np.array([])
    return eig[:min(n, k)], n, cols


def _tables(spark, eig: np.ndarray, n: int, k: int, target: float = 0.95):
    eig = np.clip(eig, 0.0, None)
    total = float(eig.sum())
    rows = [(i + 1, float(v / total)) for i, v in enumerate(eig)] if total > 0 else []
    t = spark.createDataFrame(rows, "component int, explained_variance_ratio double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    variance = t.withColumn("cumulative_variance", F.sum("explained_variance_ratio").over(w))
    schema = ("n_components int, n_components_95_variance int, total_explained_variance double, "
              "complete_rows long")
    if total <= 0:
        summary = spark.createDataFrame([(k, None, None, n)], schema)
    else:
        cum = np.cumsum(eig / total)
        summary = spark.createDataFrame([(k, int(np.argmax(cum >= target) + 1), float(cum[-1]), n)], schema)
    return variance, summary


def pca(df: DataFrame, cols: list[str] | None = None, pairs: DataFrame | None = None,
        facts=None) -> tuple[DataFrame, DataFrame]:
    """``(variance, summary)`` from ONE spectrum.  With ``pairs`` (a
    :func:`relate.correlation_pairs` result) and ``facts`` showing no missing
    numeric cell, no data pass is needed at all."""
    spark = df.sparkSession
    cols = ColumnRoles.of(df).numeric if cols is None else cols
    if pairs is not None and facts is not None and all(facts.complete(c) for c in cols):
        eig = spectrum_from_pairs(pairs, cols, facts.rows, {c for c in cols if facts.constant(c)})
        return _tables(spark, eig, facts.rows, len(cols))
    eig, n, cols = pca_spectrum(df, cols)
    return _tables(spark, eig, n, len(cols))


def pca_variance(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(component, explained_variance_ratio, cumulative_variance)``,
    components numbered from 1.  Empty when there is no complete row or no
    variance at all."""
    return pca(df, cols)[0]


def scree_lines(variance: DataFrame, shares=(0.8, 0.95)) -> DataFrame:
    """The scree chart's lines: ``(share, component, cumulative_variance)`` with the first component
    at which the cumulative variance reaches each share; no row without components."""
    lines = variance.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    # a share may be met up to rounding by the last component alone
    reached = lines.join(F.broadcast(variance), F.col("cumulative_variance") >= F.col("share") - 1e-12)  # k rows
    return reached.groupBy("share").agg(F.min(F.struct("component", "cumulative_variance")).alias("m")).select(
        "share", "m.component", "m.cumulative_variance")


def pca_summary(df: DataFrame, cols: list[str] | None = None, target: float = 0.95) -> DataFrame:
    """X1 summary: ``(n_components, n_components_95_variance, total_explained_variance, complete_rows)``."""
    return pca(df, cols)[1]
