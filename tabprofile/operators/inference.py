"""Tests of distribution and of homogeneity between classes, with p-values.

* ``normality``: Kolmogorov-Smirnov (Lilliefors) and Anderson-Darling statistics of each
  numeric column against a normal distribution with the column's own mean and deviation;
* ``kruskal_wallis`` and ``mann_whitney``: differences between classes by ranks;
* ``levene``: differences in spread, about the class medians (Brown-Forsythe) or means;
* ``anova_test`` and ``chi_square_test``: the statistics of ``relate.anova`` and
  ``categorical.chi_square`` with their p-values.

Rank statistics are sums over distinct values: equal values are counted first (combined in
each task) and range-partitioned; exact running counts (``ranks.running``, or per range in
``_rank_sums``) give each value the rows below it, so no task ranks a whole column.  Class
medians come from ``quantiles.group_quantiles``.  Only a row a column or class
reaches the driver.  NaN counts as missing; rows without a class are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.functions.special import chi_square_sf, f_sf, log_normal_sf, normal_sf
from tabprofile.operators import categorical, relate, stats
from tabprofile.operators.quantiles import group_quantiles
from tabprofile.operators.ranks import running
from tabprofile.roles import ColumnRoles, normalize, qcol
from tabprofile.sources.sinks import shared_table


def _features(df: DataFrame, cols: list[str] | None, target: str | None = None) -> list[str]:
    return [c for c in (ColumnRoles.of(df).numeric if cols is None else cols) if c != target]


def _values(df: DataFrame, cols: list[str], *keys: Column) -> DataFrame:
    """Rows (feature, value) of all present values, with ``keys``."""
    members = [F.struct(F.lit(c).alias("feature"), qcol(c).cast("double").alias("value")) for c in cols]
    return df.select(*keys, F.inline(F.array(*members))).where("value is not null")


def _lilliefors_p(d: Column, n: Column) -> Column:
    """p-value of the Lilliefors statistic; NULL below 5 values.

    Fixed values: the approximation of Dallal and Wilkinson (1986), and above 0.1 the
    polynomials of the modified statistic that statistical packages use with it."""
    large = n > 100
    k = F.when(large, d * F.pow(n / 100.0, F.lit(0.49))).otherwise(d)
    m = F.least(n, F.lit(100)).cast("double")
    p = F.exp(-7.01256 * k * k * (m + 2.78019) + 2.99587 * k * F.sqrt(m + 2.78019) - 0.122119 + 0.974598 / F.sqrt(m) + 1.67997 / m)
    q = (F.sqrt(n) - 0.01 + 0.85 / F.sqrt(n)) * d

    def polynomial(*c):
        out = F.lit(0.0)
        for x in reversed(c):
            out = out * q + x
        return out

    high = (F.when(q <= 0.302, F.lit(1.0)).when(q <= 0.5, polynomial(2.76773, -19.828315, 80.709644, -138.55152, 81.218052))
            .when(q <= 0.9, polynomial(-4.901232, 40.662806, -97.490286, 94.029866, -32.355711))
            .when(q <= 1.31, polynomial(6.198765, -19.558097, 23.186922, -12.234627, 2.423045)).otherwise(F.lit(0.0)))
    return F.when((n >= 5) & d.isNotNull(), F.when(p <= 0.1, p).otherwise(high))


def _anderson_p(a: Column, n: Column) -> Column:
    """p-value of the Anderson-Darling statistic with both parameters estimated; NULL below 8.

    Fixed values: D'Agostino and Stephens (1986)."""
    s = a * (1 + 0.75 / n + 2.25 / (n * n))
    return F.when((n >= 8) & a.isNotNull(), F.when(s < 0.2, 1 - F.exp(-13.436 + 101.14 * s - 223.73 * s * s))
                  .when(s < 0.34, 1 - F.exp(-8.318 + 42.796 * s - 59.938 * s * s))
                  .when(s < 0.6, F.exp(0.9177 - 4.279 * s - 1.38 * s * s))
                  .when(s < 10, F.exp(1.2937 - 5.709 * s + 0.0186 * s * s)).otherwise(F.lit(0.0)))


def normality(df: DataFrame, cols: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """D-j: ``(feature, n, ks_stat, ks_p, ad_stat, ad_p, normal)``; ``normal`` says that neither
    test rejects at ``alpha``.  NULL where the deviation is 0 or unknown (constant columns,
    infinite values, too few values)."""
    df = normalize(df)
    cols = _features(df, cols)
    m = [(r["column_name"], r["count"], r["mean"], r["std"]) for r in stats.numeric_moments(df, cols).collect()] if cols else []
    facts = df.sparkSession.createDataFrame(m, "own string, n long, mean double, std double")  # a row a column
    if not cols:
        return facts.select(F.col("own").alias("feature"), "n", *[F.lit(None).cast("double").alias(c) for c in ("ks_stat", "ks_p", "ad_stat", "ad_p")],
                            F.lit(None).cast("boolean").alias("normal"))
    counts = _values(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = running(counts, [F.col("value")], {"before": F.col("c")}, ["feature"])
    known = ranked.join(F.broadcast(facts.where("std > 0")), F.col("feature") == F.col("own"))
    z = (F.col("value") - F.col("mean")) / F.col("std")
    both = known.select("feature", "n", "c", "before", log_normal_sf(-z).alias("below"), log_normal_sf(z).alias("above"))
    cdf, n, c, before = F.exp("below"), F.col("n"), F.col("c"), F.col("before")
    sums = both.groupBy("feature").agg(
        F.max(F.greatest((before + c) / n - cdf, cdf - before / n)).alias("ks_stat"),
        F.sum(c * (2 * before + c).cast("double") * F.col("below") + c * (2 * (n - before) - c).cast("double") * F.col("above")).alias("s"))
    found = facts.join(sums, F.col("own") == F.col("feature"), "left").select(F.col("own").alias("feature"), "n", "ks_stat",
                                                                              F.try_divide(-F.col("s"), n).alias("a"))
    found = found.select("feature", "n", "ks_stat", (F.col("a") - n).alias("ad_stat"))
    found = found.select("feature", "n", "ks_stat", _lilliefors_p(F.col("ks_stat"), n).alias("ks_p"), "ad_stat",
                         _anderson_p(F.col("ad_stat"), n).alias("ad_p"))
    return found.select("*", ((F.col("ks_p") >= alpha) & (F.col("ad_p") >= alpha)).alias("normal"))


def _local_ranks(batches):
    """Rows (f, first, class, n, r, total, ties) of one range of counts (f, value, class, c), sorted by f and value.

    ``first`` is the feature's least value in the range.  Rows with a class hold its rows and the
    sum of their ranks counted from ``first``; the row without class holds all rows and the sum
    of t^3 - t.  Each batch gives rows of its own; what travels on is the last value, whose
    counts may go on in the next batch, and the rows of its feature so far."""
    import numpy as np
    import pyarrow as pa
    kind = pa.schema([("f", pa.int32()), ("first", pa.float64()), ("class", pa.string()), ("n", pa.int64()), ("r", pa.float64()),
                      ("total", pa.int64()), ("ties", pa.float64())])
    held, feature, first, before = None, None, None, 0

    def added(table):
        nonlocal feature, first, before
        f, v, c = (table.column(x).to_numpy() for x in ("f", "value", "c"))
        for a, z in zip(*_stretches(f, np)):
            if f[a] != feature:
                feature, first, before = f[a], v[a], 0
            starts, ends = _stretches(v[a:z], np)
            t = np.add.reduceat(c[a:z], starts)
            places = before + np.cumsum(t) - t + (t + 1) / 2
            part = table.slice(a, z - a)
            ranks = pa.table({"class": part.column("class"), "n": part.column("c"), "r": c[a:z] * np.repeat(places, ends - starts)})
            by = ranks.group_by("class").aggregate([("n", "sum"), ("r", "sum")])
            d, size = t.astype(float), int(t.sum())
            k = by.num_rows
            yield pa.RecordBatch.from_pydict({
                "f": [feature] * (k + 1), "first": [first] * (k + 1), "class": [*by.column("class").to_pylist(), None],
                "n": [*by.column("n_sum").to_pylist(), None], "r": [*by.column("r_sum").to_pylist(), None],
                "total": [None] * k + [size], "ties": [None] * k + [float((d * d * d - d).sum())]}, kind)
            before += size

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        f, v = table.column("f").to_numpy(), table.column("value").to_numpy()
        last = int(((f == f[-1]) & (v == v[-1])).argmax())
        held = table.slice(last)
        yield from added(table.slice(0, last))
    if held is not None:
        yield from added(held)


def _stretches(x, np):
    """Where the stretches of equal neighbours in ``x`` begin and end."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    return np.append([0] if len(x) else [], cuts).astype(int), np.append(cuts, [len(x)] if len(x) else []).astype(int)


def _rank_sums(df: DataFrame, target: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(feature, class, n, r): rows and sum of average ranks of each class; and (feature, total, ties):
    rows and the sum of t^3 - t over groups of t equal values.

    Counts of (feature, value, class) are sorted once by range, a value in one range; each range is
    summed up where it lies (:func:`_local_ranks`), and the rows of the ranges below raise its
    ranks.  Beside the counts all tables are small: some rows a range, feature and class."""
    cls = qcol(target).cast("string").alias("class")
    members = [F.struct(F.lit(i).alias("f"), qcol(c).cast("double").alias("value")) for i, c in enumerate(cols)]
    values = df.where(qcol(target).isNotNull()).select(cls, F.inline(F.array(*members))).where("value is not null")
    counts = values.groupBy("f", "value", "class").agg(F.count(F.lit(1)).alias("c"))
    ordered = counts.repartitionByRange("f", "value").sortWithinPartitions("f", "value")
    parts = ordered.select("f", "value", "class", "c").mapInArrow(
        _local_ranks, "f int, first double, class string, n long, r double, total long, ties double")
    parts = shared_table(parts, "rank-sums")
    whole = parts.where("class is null")
    below = Window.partitionBy("own").orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and feature
    offsets = whole.groupBy(F.col("f").alias("own"), F.col("first").alias("least")).agg(F.sum("total").alias("here")).select(
        "own", "least", F.coalesce(F.sum("here").over(below), F.lit(0)).alias("offset"))
    feature = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("f") + 1).alias("feature")
    raised = parts.where("class is not null").join(offsets, (F.col("f") == F.col("own")) & (F.col("first") == F.col("least")))
    sums = raised.groupBy(feature, "class").agg(F.sum("n").alias("n"), F.sum(F.col("r") + F.col("n") * F.col("offset").cast("double")).alias("r"))
    return sums, whole.groupBy(feature).agg(F.sum("total").alias("total"), F.sum("ties").alias("ties"))


def kruskal_wallis(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """D-j: ``(feature, groups, n, h_stat, dof, p_value)`` over the classes of ``target``, corrected
    for ties.  Fewer than two classes or equal values alone give NULL."""
    df = normalize(df)
    cols = _features(df, cols, target)
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, groups long, n long, h_stat double, dof long, p_value double")
    sums, totals = _rank_sums(df, target, cols)
    by = sums.groupBy("feature").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1))
    both = by.join(totals.withColumnRenamed("feature", "f"), F.col("feature") == F.col("f"))
    found = both.select("feature", "groups", "n", F.when(F.col("groups") > 1, F.try_divide(h, 1 - F.try_divide(F.col("ties"), n * n * n - n))).alias("h_stat"),
                        (F.col("groups") - 1).alias("dof"))
    return found.select("*", chi_square_sf(F.greatest(F.col("h_stat"), F.col("h_stat") * 0), F.col("dof").cast("double")).alias("p_value"))


def mann_whitney(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """D-j: ``(feature, class_a, class_b, n_a, n_b, u_stat, z, p_value)`` for a target of two
    classes (a before b by name): U of class a, and the two-sided normal approximation with
    corrections for ties and continuity.  A feature with values in one class alone gives NULL;
    a target of another number of classes raises."""
    df = normalize(df)
    cols = _features(df, cols, target)
    classes = [r[0] for r in df.where(qcol(target).isNotNull()).select(qcol(target).cast("string").alias("k")).distinct().orderBy("k").limit(3).collect()]
    if len(classes) != 2:
        raise ValueError(f"the Mann-Whitney test needs a target of two classes; {target} has {'more' if len(classes) > 2 else len(classes)}")
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, class_a string, class_b string, n_a long, n_b long, u_stat double, z double, p_value double")
    sums, totals = _rank_sums(df, target, cols)
    own = F.col("class") == classes[0]
    by = sums.groupBy("feature").agg(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("n_a"),
                                     F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("n_b"), F.sum(F.when(own, F.col("r"))).alias("r"))
    both = by.join(totals.withColumnRenamed("feature", "f"), F.col("feature") == F.col("f"))
    a, b, n = (F.col(c).cast("double") for c in ("n_a", "n_b", "total"))
    u = F.when((a > 0) & (b > 0), F.col("r") - a * (a + 1) / 2)
    sd = F.sqrt(a * b / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    found = both.select("feature", F.lit(classes[0]).alias("class_a"), F.lit(classes[1]).alias("class_b"), "n_a", "n_b", u.alias("u_stat"),
                        F.try_divide(F.greatest(u, a * b - u) - a * b / 2 - 0.5, sd).alias("z"))
    return found.select("*", F.when(F.col("z").isNotNull(), F.least(2 * normal_sf(F.col("z")), F.lit(1.0))).alias("p_value"))


def levene(df: DataFrame, target: str, cols: list[str] | None = None, center: str = "median") -> DataFrame:
    """D-j: ``(feature, groups, n, w_stat, p_value)``: one-way analysis of variance of the
    distances from the class ``center``: ``median`` (Brown-Forsythe) or ``mean`` (Levene).

    Fewer than two classes, no spread or infinite values give NULL."""
    if center not in ("median", "mean"):
        raise ValueError(f"unknown center: {center}")
    df = normalize(df)
    cols = _features(df, cols, target)
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, groups long, n long, w_stat double, p_value double")
    if center == "median":
        centers = group_quantiles(df, cols, target, [0.5]).select("class", F.col("column_name").alias("feature"), F.col("value").alias("mid"))
    else:
        centers = relate.group_moments(df, target, cols).select("class", "feature", F.col("mean").alias("mid"))
    centers = shared_table(centers.select(F.col("class").alias("k"), F.col("feature").alias("f"), "mid"), "centers")
    values = _values(df.where(qcol(target).isNotNull()), cols, qcol(target).cast("string").alias("class"))
    side = F.broadcast(centers) if centers.count() <= CENTERS_BROADCAST else centers
    far = values.join(side, (F.col("class") == F.col("k")) & (F.col("feature") == F.col("f"))).select(
        "feature", "class", F.abs(F.col("value") - F.col("mid")).alias("z"))
    g = far.groupBy("feature", "class").agg(F.count(F.lit(1)).alias("c"), F.avg("z").alias("m"), F.coalesce(F.var_pop("z"), F.lit(0.0)).alias("v"))
    # a second level over a row a class: between and within from counts, means and variances
    tot = g.groupBy("feature").agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("within"),
                                   (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("grand"))
    between = g.join(tot.select(F.col("feature").alias("f"), "grand"), F.col("feature") == F.col("f")).groupBy(F.col("feature").alias("own")).agg(
        F.sum(F.col("c") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"))
    d1, d2 = (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")
    w = F.when(F.col("groups") > 1, F.try_divide(F.try_divide(F.col("between"), d1), F.try_divide(F.col("within"), d2)))
    found = tot.join(between, F.col("feature") == F.col("own")).select("feature", "groups", "n", F.nanvl(w, F.lit(None)).alias("w_stat"))
    return found.select("*", f_sf(F.col("w_stat"), d1, d2).alias("p_value"))


CENTERS_BROADCAST = 200_000  # most (class, feature) rows of ``levene`` that are broadcast


def anova_test(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """B4 with its p-value: ``(feature, groups, n, f_stat, p_value)``.  Fewer than two classes
    give F 0 and no p-value; no spread inside the classes gives NULL."""
    g = relate.group_moments(df, target, cols).groupBy(F.col("feature").alias("own")).agg(F.sum("n").alias("n"))
    found = relate.anova(df, target, cols).join(g, F.col("feature") == F.col("own")).select("feature", "groups", "n", "f_stat")
    p = f_sf(F.col("f_stat"), (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double"))
    return found.select("*", p.alias("p_value"))


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """B5 with its p-value: ``(chi2, dof, n, yates, p_value)``; NULL without degrees of freedom."""
    found = categorical.chi_square(df, a, b)
    return found.select("*", chi_square_sf(F.greatest(F.col("chi2"), F.col("chi2") * 0), F.col("dof").cast("double")).alias("p_value"))
