"""Moments and correlations from mean-shifted power sums.

Spark's central-moment aggregates (``stddev``, ``skewness``, ``kurtosis``,
``covar_pop``) update several buffers with divisions per row; dozens of them
in one fused aggregate also produce generated methods too large for the JIT.
Here every statistic comes from plain ``sum`` aggregates of ``d = x - shift``
where ``shift`` is the column mean from a cheap first pass (``count``,
``min``, ``max``, ``avg``).  Shifting by the mean keeps the sums well
conditioned -- the same mean-adjusted sums pandas uses -- and sums merge
exactly across partitions.  Only O(columns) literals (the facts) reach the
driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.roles import qcol

SUM_CHUNK = 120  # sum aggregates per fused pass (keeps generated methods JIT-sized)


@dataclass
class Facts:
    rows: int
    count: dict
    min: dict
    max: dict
    mean: dict

    def complete(self, c: str) -> bool:
        return self.count[c] == self.rows

    def constant(self, c: str) -> bool:
        return self.count[c] == 0 or self.min[c] == self.max[c]


def column_facts(df: DataFrame, cols: list[str]) -> Facts:
    """One fused pass: row count and, per column, count / min / max / mean."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.avg(x).alias(f"mu{i}")]
    r = df.agg(*aggs).first()
    return Facts(r["rows"], {c: r[f"n{i}"] for i, c in enumerate(cols)},
                 {c: r[f"lo{i}"] for i, c in enumerate(cols)}, {c: r[f"hi{i}"] for i, c in enumerate(cols)},
                 {c: r[f"mu{i}"] for i, c in enumerate(cols)})


def _d(c: str, facts: Facts) -> Column:
    return qcol(c).cast("double") - F.lit(facts.mean[c] if facts.mean[c] is not None else 0.0)


def _scale(c: str, facts: Facts) -> float:
    """What distances from the mean are divided by so that their fourth powers stay in range:
    1 but for columns whose values lie further than 1e60, or all nearer than 1e-60."""
    if not facts.count[c] or not all(map(math.isfinite, (facts.min[c], facts.max[c], facts.mean[c]))):
        return 1.0
    widest = max(facts.max[c] / 2 - facts.mean[c] / 2, facts.mean[c] / 2 - facts.min[c] / 2)
    return widest if widest > 1e60 or 0 < widest < 1e-60 else 1.0


def _chunked_row(df: DataFrame, named: list[tuple[str, Column]]) -> list[DataFrame]:
    """Evaluate many sum aggregates in passes of ``SUM_CHUNK``; returns one-row frames."""
    return [df.agg(*[e.alias(n) for n, e in named[s:s + SUM_CHUNK]]) for s in range(0, len(named), SUM_CHUNK)]


def _one_row(parts: list[DataFrame]) -> dict:
    out = {}
    for p in parts:
        out.update(p.first().asDict())
    return out


def moment_rows(df: DataFrame, cols: list[str], facts: Facts | None = None) -> list[tuple]:
    """``(column, count, mean, std, min, max, skewness, kurtosis)`` tuples with
    pandas semantics: sample std; adjusted skewness (NULL below 3 values) and
    excess kurtosis (NULL below 4); 0 for a constant column.  With infinite values all three
    are NULL (D1)."""
    facts = facts or column_facts(df, cols)
    named, scales = [], {c: _scale(c, facts) for c in cols}
    for i, c in enumerate(cols):
        d = _d(c, facts) if scales[c] == 1.0 else _d(c, facts) / F.lit(scales[c])
        named += [(f"s1_{i}", F.sum(d)), (f"s2_{i}", F.sum(d * d)), (f"s3_{i}", F.sum(d * d * d)),
                  (f"s4_{i}", F.sum((d * d) * (d * d)))]
    sums = _one_row(_chunked_row(df, named)) if named else {}
    rows = []
    for i, c in enumerate(cols):
        n = facts.count[c]
        if not n:
            rows.append((c, 0, None, None, None, None, None, None))
            continue
        s1, s2, s3, s4 = (sums[f"s{k}_{i}"] for k in (1, 2, 3, 4))
        if not all(map(math.isfinite, (s1, s2, s3, s4))):  # infinite values have no spread
            mean = None if math.isnan(facts.mean[c]) else facts.mean[c]
            rows.append((c, n, mean, None, facts.min[c], facts.max[c], None, None))
            continue
        mu = s1 / n
        m2 = s2 / n - mu * mu
        m3 = s3 / n - 3 * mu * s2 / n + 2 * mu ** 3
        m4 = s4 / n - 4 * mu * s3 / n + 6 * mu * mu * s2 / n - 3 * mu ** 4
        const = facts.constant(c)
        mean = facts.mean[c]  # the plain average; mu only corrects the central moments
        std = None if n < 2 else (0.0 if const else max(m2, 0.0) ** 0.5 * (n / (n - 1)) ** 0.5 * scales[c])
        if n < 3:
            skew = None
        elif const or m2 <= 0:
            skew = 0.0
        else:
            skew = m3 / m2 ** 1.5 * (n * (n - 1)) ** 0.5 / (n - 2)
        if n < 4:
            kurt = None
        elif const or m2 <= 0:
            kurt = 0.0
        else:
            kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)
        rows.append((c, n, mean, std, facts.min[c], facts.max[c], skew, kurt))
    return rows


def gram_sums(df: DataFrame, cols: list[str], facts: Facts, against: str | None = None) -> dict:
    """Pairwise-complete shifted sums for every pair ``i < j`` of ``cols``, or only for the
    pairs ``(c, against)``, in ONE
    pass: each task turns its Arrow batches into NumPy blocks and accumulates
    the masked Gram products (``M'M`` counts, ``D'M`` / ``(D*D)'M`` one-sided
    sums, ``D'D`` cross products, with ``D`` the shifted values, 0 where
    missing); it emits k(k-1)/2 partial rows, and one ``groupBy(pair).sum``
    merges them (k - 1 rows and products a task with ``against``).  Returns ``{(a, b): (n, sa, sb, saa, sbb, sab)}``."""
    import numpy as np
    import pandas as pd

    k = len(cols)
    iu = np.triu_indices(k, 1)
    last = None if against is None else cols.index(against)
    if against is not None:
        iu = (np.array([i for i in range(k) if i != last]), np.full(k - 1, last))
    shifts = np.array([facts.mean[c] if facts.mean[c] is not None else 0.0 for c in cols])
    names = [f"c{i}" for i in range(k)]

    def partials(batches):
        n = np.zeros((k, k)); sx = np.zeros((k, k)); sxx = np.zeros((k, k)); sxy = np.zeros((k, k))
        tx, txx = np.zeros(k), np.zeros(k)
        for pdf in batches:
            x = pdf[names].to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(x)
            d = np.where(m, x - shifts, 0.0)
            mf = m.astype("float64")
            if last is not None:  # one column of each product, and of the one-sided sums one row, too
                n[:, last] += mf.T @ mf[:, last]
                sx[:, last] += d.T @ mf[:, last]
                sxx[:, last] += (d * d).T @ mf[:, last]
                sxy[:, last] += d.T @ d[:, last]
                tx += d[:, last] @ mf
                txx += (d[:, last] ** 2) @ mf
                continue
            n += mf.T @ mf
            sx += d.T @ mf
            sxx += (d * d).T @ mf
            sxy += d.T @ d
        if last is not None:
            sx[last], sxx[last] = tx, txx
        yield pd.DataFrame({"pos": np.arange(len(iu[0]), dtype="int64"), "n": n[iu], "sa": sx[iu], "sb": sx.T[iu],
                            "saa": sxx[iu], "sbb": sxx.T[iu], "sab": sxy[iu]})

    schema = "pos long, n double, sa double, sb double, saa double, sbb double, sab double"
    part = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInPandas(partials, schema)
    merged = part.groupBy("pos").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    out = {}
    for r in merged.collect():  # k(k-1)/2 rows: the size of the answer itself
        i, j = int(iu[0][r["pos"]]), int(iu[1][r["pos"]])
        out[(cols[i], cols[j])] = (int(round(r["n"])), r["sa"], r["sb"], r["saa"], r["sbb"], r["sab"])
    return out


def _r(n, sa, sb, saa, sbb, sab):
    if not n or sab is None or not all(map(math.isfinite, (sa, sb, saa, sbb, sab))):
        return None
    caa, cbb, cab = saa - sa * sa / n, sbb - sb * sb / n, sab - sa * sb / n
    # a side that is constant over the complete pairs leaves only rounding noise
    if caa <= 1e-13 * max(saa, 1e-300) or cbb <= 1e-13 * max(sbb, 1e-300):
        return None
    return cab / (caa * cbb) ** 0.5


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]], facts: Facts) -> dict:
    """Pearson r over pairwise-complete rows for every ``(a, b)`` pair; ``None`` where a
    side is constant over those rows, holds an infinity, or no pair is complete.  One pass
    for any number of pairs (:func:`gram_sums`)."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    sides = [set(p) for p in pairs if p[0] != p[1]]
    shared = set.intersection(*sides) if len(sides) > 1 else set()
    g = gram_sums(df, cols, facts, shared.pop() if shared else None) if pairs else {}
    out = {}
    for a, b in pairs:
        if a == b:
            out[(a, b)] = None if facts.constant(a) else 1.0
        elif facts.constant(a) or facts.constant(b):
            out[(a, b)] = None
        else:
            n, sa, sb, saa, sbb, sab = g[(a, b)] if (a, b) in g else (lambda t: (t[0], t[2], t[1], t[4], t[3], t[5]))(g[(b, a)])
            out[(a, b)] = _r(n, sa, sb, saa, sbb, sab)
    return out
