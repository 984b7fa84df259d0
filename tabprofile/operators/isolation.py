"""D-c: isolation forest, an outlier score of whole rows.

Each tree is grown on a seeded subsample of ``sample`` rows: at every node a random feature with
more than one value is split at a uniform point between its least and greatest value, until
a row stands alone or ceil(log2(sample)) levels are reached.  A row's score is
2 ** (-E[path] / c(sample)), where c(n) is the mean path of an unsuccessful search among n rows;
rows that few splits set apart score near 1.

The trees together see at most ``trees * sample`` rows, the documented bound of the fit
(25,600 by default): an exact, reproducible sample (``clean.sample_rows``) is dealt to the
trees and each grows in its own group, so trees grow in parallel tasks.  The forest, at most
``trees * 2 * sample`` nodes, is broadcast, and one pass scores every row of the table with
vectorised Arrow code; only the numeric features travel to Python.

Missing values go to the side that holds more sampled rows.  Infinities count as the largest
finite numbers.  A table without rows gives no scores, one with equal rows 0.5 for all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.operators.clean import sample_rows
from tabprofile.operators.quantiles import quantiles
from tabprofile.roles import ColumnRoles, normalize, qcol
from tabprofile.sources.sinks import shared_table

NODES = "tree int, node int, feature int, split double, left int, right int, missing_left boolean, path double"
LARGEST = 1.7976931348623157e308


def mean_path(n: int) -> float:
    """c(n): the mean depth at which an unsuccessful search among n rows ends."""
    if n < 2:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(x, rng, limit: int) -> list[tuple]:
    """The nodes (node, feature, split, left, right, missing_left, path) of one tree over the rows
    of ``x`` (NaN: missing).  A leaf has feature -1 and its depth plus c(rows) as path."""
    import numpy as np
    out, todo = [], [(0, np.arange(len(x)), 0)]
    made = 1
    while todo:
        node, rows, depth = todo.pop()
        here = x[rows]
        open_ = []
        if depth < limit and len(rows) > 1:
            low = np.where(np.isnan(here), np.inf, here).min(0)
            high = np.where(np.isnan(here), -np.inf, here).max(0)
            open_ = np.flatnonzero(low < high)
        if not len(open_):
            out.append((node, -1, 0.0, 0, 0, False, depth + mean_path(len(rows))))
            continue
        f = int(rng.choice(open_))
        u = rng.random()
        split = float(low[f] * (1 - u) + high[f] * u)
        left = here[:, f] < split
        if not left.any():  # the point fell on the least value
            split = float(np.nextafter(low[f], np.inf))
            left = here[:, f] < split
        missing = np.isnan(here[:, f])
        missing_left = bool(left.sum() >= (~left & ~missing).sum())
        left |= missing & missing_left
        out.append((node, f, split, made, made + 1, missing_left, 0.0))
        todo += [(made, rows[left], depth + 1), (made + 1, rows[~left], depth + 1)]
        made += 2
    return out


WALKED = 4096  # rows walked down the trees at a time: their work arrays stay in the processor's cache


def path_lengths(x, forest) -> "object":
    """The mean path of each row of ``x`` over the trees of ``forest`` (:func:`_arrays`).

    Each feature stands twice in a block: missing values as -inf, which goes left at every
    split, then as inf, which goes right.  A node names the one it wants, so a step down a level
    is a comparison added to the number of the left child."""
    import numpy as np
    total = np.zeros(len(x))
    width = 2 * x.shape[1]
    for start in range(0, len(x), WALKED):
        part = x[start:start + WALKED]
        gaps = np.isnan(part)
        flat = np.concatenate([np.where(gaps, -np.inf, part), np.where(gaps, np.inf, part)], 1).ravel()
        base = np.arange(len(part), dtype=np.intp) * width
        at, cell, left = (np.empty(len(part), np.intp) for _ in range(3))
        value, split = np.empty(len(part)), np.empty(len(part))
        right, sums = np.empty(len(part), bool), total[start:start + WALKED]
        for columns, splits, lefts, path, depth in forest:
            at[:] = 0
            for _ in range(depth):
                # every number is in bounds; a mode other than raise spares numpy a copy of ``out``
                np.add(base, columns.take(at, out=cell, mode="clip"), out=cell)
                np.greater_equal(flat.take(cell, out=value, mode="clip"), splits.take(at, out=split, mode="clip"), out=right)
                np.add(lefts.take(at, out=left, mode="clip"), right, out=at)
            sums += path.take(at)
    return total / max(len(forest), 1)


def _matrix(columns):
    import numpy as np
    x = np.stack([np.asarray(c, "float64") for c in columns], 1)
    return np.clip(x, -LARGEST, LARGEST)


def fit(df: DataFrame, cols: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """The forest's nodes as a table (``NODES``); ``df`` is normalised."""
    import numpy as np
    features = df.select(*[qcol(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # stored, so that the table is read for it once; at most trees * sample rows from here on
    some = shared_table(sample_rows(features, trees * sample, seed, stored=True), "isolation-sample")
    order = Window.orderBy(F.md5(F.concat_ws("|", *[F.col(f"c{i}").cast("string") for i in range(len(cols))], F.lit(str(seed)))))
    placed = some.withColumn("place", F.row_number().over(order) - 1)
    n = placed.count()
    if n >= trees * sample:
        dealt = placed.withColumn("tree", (F.col("place") % trees).cast("int"))
    else:  # fewer rows than the trees ask for: each tree draws its own from all
        every = placed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        own = Window.partitionBy("tree").orderBy(F.xxhash64("place", "tree", F.lit(seed)), "place")
        dealt = every.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= sample).drop("rank")
    names, limit = [f"c{i}" for i in range(len(cols))], max(1, math.ceil(math.log2(max(2, min(sample, n)))))

    def one(key, pdf):
        import pandas as pd
        pdf = pdf.sort_values("place")
        rng = np.random.default_rng([seed, int(key[0])])
        nodes = grow(_matrix([pdf[c] for c in names]), rng, limit)
        return pd.DataFrame([(int(key[0]), *x) for x in nodes], columns=[f.split()[0] for f in NODES.split(", ")])

    return dealt.groupBy("tree").applyInPandas(one, NODES)


def _arrays(nodes, features: int) -> list[tuple]:
    """Collected nodes as arrays a tree, for :func:`path_lengths`: the place of the value that a
    node compares, its split, left child (the right one follows it) and path, and the levels to walk.

    A leaf compares the first feature, missing as -inf, with inf, and so leads to itself."""
    import numpy as np
    trees: dict[int, list] = {}
    for r in nodes:
        trees.setdefault(r["tree"], []).append(r)
    out = []
    for _, rows in sorted(trees.items()):
        rows.sort(key=lambda r: r["node"])
        column = lambda name, kind: np.array([r[name] for r in rows], kind)
        depth = [0] * len(rows)
        for r in rows:  # children have larger numbers than their parent
            if r["feature"] >= 0:
                depth[r["left"]] = depth[r["right"]] = depth[r["node"]] + 1
        feature, number = column("feature", np.intp), np.arange(len(rows))
        leaf = feature < 0
        out.append((np.where(leaf, 0, feature + np.where(column("missing_left", bool), 0, features)),
                    np.where(leaf, np.inf, column("split", float)), np.where(leaf, number, column("left", np.intp)),
                    column("path", float), max(depth)))
    return out


def isolation_scores(df: DataFrame, cols: list[str] | None = None, trees: int = 100, sample: int = 256, seed: int = 42,
                     name: str = "anomaly_score") -> DataFrame:
    """All rows and columns of ``df`` with the score of the row's numeric columns (``cols``)."""
    if name in df.columns:
        raise ValueError(f"the table already has a column {name}")
    base = normalize(df)
    cols = ColumnRoles.of(base).numeric if cols is None else cols
    if not cols:
        raise ValueError("an isolation forest needs a numeric column")
    nodes = fit(base, cols, trees, sample, seed).collect()  # at most trees * 2 * sample rows
    if not nodes:
        return df.withColumn(name, F.lit(None).cast("double"))
    forest = _arrays(nodes, len(cols))
    grown = sum(r["feature"] < 0 for r in nodes)
    rows = min(sample, base.limit(sample).count()) if grown else 0
    bc = df.sparkSession.sparkContext.broadcast(forest)
    scale = mean_path(rows)

    @F.arrow_udf("double")
    def score(*columns):
        import numpy as np
        import pyarrow as pa
        x = _matrix([c.to_numpy(zero_copy_only=False) for c in columns])
        path = path_lengths(x, bc.value)
        return pa.array(np.exp2(-path / scale) if scale else np.full(len(x), 0.5))

    number = [F.nanvl(qcol(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    return df.select(*[qcol(c) for c in df.columns], score(*number).alias(name))


def isolation_outliers(df: DataFrame, cols: list[str] | None = None, threshold: float | None = None, contamination: float = 0.01,
                       trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """``(method, threshold, outlier_count, outlier_percentage)``: rows whose score exceeds
    ``threshold``; without one the exact quantile that leaves ``contamination`` of the rows above.

    Rows are scored once: quantile and count read the stored scores, a number a row."""
    scores = isolation_scores(df, cols, trees, sample, seed, "__score").select(qcol("__score").alias("score"))
    scores = shared_table(scores, "scores")
    if threshold is None:
        threshold = quantiles(scores, ["score"], [1 - contamination]).first()["value"]
    return scores.agg(F.coalesce(F.count_if(F.col("score") > F.lit(threshold)), F.lit(0)).alias("outlier_count"), F.count("score").alias("n")).select(
        F.lit("isolation_forest").alias("method"), F.lit(threshold).cast("double").alias("threshold"), "outlier_count",
        F.try_divide(F.col("outlier_count") * 100.0, F.col("n")).alias("outlier_percentage"))
