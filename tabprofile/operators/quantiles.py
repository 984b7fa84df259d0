"""Exact quantiles with linear interpolation, for many columns at once.

Semantics: for the ``n`` non-missing values of a column sorted ascending,
position ``h = (n - 1) * p``; the answer is ``v[floor h] + (h - floor h) *
(v[ceil h] - v[floor h])`` -- the pandas / DuckDB ``quantile_cont`` rule.

Plan:

* bracket refinement: one pass builds an equal-width histogram
  (count, min, max per bucket) of every open bracket ``[lo, hi]`` -- a hash
  aggregate combined in each task -- and running counts over its buckets
  find the bucket(s) holding the wanted ranks.  The new bracket is that
  bucket's ``[min, max]``, with exact counts below and inside, so each pass
  shrinks the value range ``buckets``-fold.  Ranks that fall on a bucket
  edge or on a single-valued bucket are pinned right away.  The loop stops
  once a bracket holds at most ``direct_limit`` values.  The final selection
  groups the in-bracket values by value (map-side combined, so a hot value
  costs one row per task) and walks their running counts in a window that
  is partitioned per (column, quantile) and bounded by ``direct_limit``.
  Columns holding -inf / +inf get one extra pass that counts them and
  finds the finite min / max, so every bracket starts finite.

Only O(columns x quantiles) literals reach the driver; no data row does.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.roles import qcol

DIRECT_LIMIT = 200_000
BUCKETS = 16_384
MEMBER_CHUNK = 64     # brackets a row is compared with in one generator
MAX_STATES = 200_000  # (class, column, quantile) brackets held by group_quantiles


def quantiles(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75), *,
              direct_limit: int = DIRECT_LIMIT, buckets: int = BUCKETS, facts=None) -> DataFrame:
    """Long table ``(column_name, prob, value)``; ``value`` is NULL for a column
    without values.  ``df`` should be normalised (NaN already NULL).  ``facts``
    (:func:`tabprofile.functions.moments.column_facts`) saves the count pass."""
    probs = [float(p) for p in probs]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, prob double, value double")
    if facts is not None:
        stats = {}
        for i, c in enumerate(cols):
            stats[f"n{i}"], stats[f"lo{i}"], stats[f"hi{i}"] = facts.count[c], facts.min[c], facts.max[c]
    else:
        stats = df.agg(*[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(cols)]
                       + [F.min(qcol(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)]
                       + [F.max(qcol(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return _bracketed(df, cols, probs, stats, direct_limit, buckets)


def _wanted(st, c, p, n, lo, hi) -> None:
    """Adds the state of one (column, quantile)."""
    if n == 0:
        st.append(dict(c=c, p=p, n=0, done=True, lo=None, hi=None, below=0, inside=0, r0=0, r1=0))
    else:
        h = (n - 1) * p
        st.append(dict(c=c, p=p, n=n, r0=int(math.floor(h)), r1=int(math.ceil(h)), lo=lo, hi=hi, below=0, inside=n, done=False))


def _bucket(x, lo, hi, buckets):
    return F.least(F.floor((x - lo) / ((hi - lo) / buckets)), F.lit(buckets - 1)).cast("int")


def _column_members(df):
    """The values of brackets (column, lo, hi) as rows (g, b, x): g is the bracket's number, b the
    bucket, if any are asked for."""
    def members(keys, buckets=None):
        out = []
        for g, (c, lo, hi) in enumerate(keys):
            x = qcol(c).cast("double")
            b = F.lit(0) if buckets is None else _bucket(x, F.lit(lo), F.lit(hi), buckets)
            out.append(F.struct(F.lit(g).alias("g"), F.when((x >= lo) & (x <= hi), b).alias("b"), x.alias("x")))
        # inline + where (not a filter lambda) keeps the generator in codegen
        parts = [df.select(F.inline(F.array(*out[s:s + MEMBER_CHUNK]))) for s in range(0, len(out), MEMBER_CHUNK)]
        return reduce(DataFrame.unionAll, parts).where(F.col("b").isNotNull())
    return members


def _group_members(df, by, cols):
    """The same for brackets ((group, column), lo, hi); the brackets are a table of groups x
    columns x quantiles rows (checked by the caller), broadcast to the rows."""
    long = df.select(qcol(by).cast("string").alias("cls"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), qcol(c).cast("double").alias("x")) for i, c in enumerate(cols)]))).where("x is not null")

    def members(keys, buckets=None):
        table = df.sparkSession.createDataFrame([(g, cls, cols.index(c), lo, hi) for g, ((cls, c), lo, hi) in enumerate(keys)],
                                                "g int, own string, col int, lo double, hi double")
        inside = long.join(F.broadcast(table), (F.col("cls") == F.col("own")) & (F.col("i") == F.col("col"))).where("x between lo and hi")
        b = F.lit(0) if buckets is None else _bucket(F.col("x"), F.col("lo"), F.col("hi"), buckets)
        return inside.select("g", b.alias("b"), "x")
    return members


def group_quantiles(df: DataFrame, cols: list[str], by: str, probs=(0.25, 0.5, 0.75), *,
                    direct_limit: int = DIRECT_LIMIT, buckets: int = 1024) -> DataFrame:
    """``(class, column_name, prob, value)``: exact quantiles of each column inside each class of
    ``by`` (rows without a class or value left out), by the same refinement: one pass
    builds the histograms of the open brackets of all classes and columns.  ``df`` should be
    normalised; a class without values of a column has no row.  Infinities are values."""
    probs = [float(p) for p in probs]
    aggs, inf = [], float("inf")
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        finite = F.when((x > -inf) & (x < inf), x)
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x == -inf).alias(f"neg{i}"), F.count_if(x == inf).alias(f"pos{i}"),
                 F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}")]
    facts = df.where(qcol(by).isNotNull()).groupBy(qcol(by).cast("string").alias("cls")).agg(*aggs)
    rows = facts.limit(MAX_STATES + 1).collect() if cols else []  # a row a class
    if len(rows) * len(cols) * len(probs) > MAX_STATES:
        raise ValueError(f"{by} has too many classes for {len(cols)} columns: at most {MAX_STATES} brackets can be kept")
    st: list[dict] = []
    for r in rows:
        for i, c in enumerate(cols):
            for p in probs:
                if r[f"n{i}"]:
                    _wanted(st, (r["cls"], c), p, r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"])
                    _pin(st[-1], r[f"neg{i}"], r[f"pos{i}"], r[f"lo{i}"], r[f"hi{i}"])
    out = _solve(df.sparkSession, st, _group_members(df, by, cols), direct_limit, buckets,
                 "struct<class: string, column_name: string>")
    return out.select("key.class", "key.column_name", "prob", "value")


def _bracketed(df, cols, probs, stats, direct_limit, buckets) -> DataFrame:
    st: list[dict] = []
    for i, c in enumerate(cols):
        for p in probs:
            _wanted(st, c, p, stats[f"n{i}"], stats[f"lo{i}"], stats[f"hi{i}"])
    _finite_brackets(df, st)
    out = _solve(df.sparkSession, st, _column_members(df), direct_limit, buckets, "string")
    return out.select(F.col("key").alias("column_name"), "prob", "value")


def _solve(spark, st, members, direct_limit, buckets, kind) -> DataFrame:
    # one state per (column, quantile); ``below`` values lie under ``lo`` and
    # ``inside`` values in [lo, hi], which always holds ranks r0 and r1
    while True:
        # (a sub-normal width leaves the bracket to the exact selection)
        todo = [s for s in st if s["n"] > 0 and "v0" not in s and s["inside"] > direct_limit
                and s["lo"] < s["hi"] and math.isfinite(s["hi"] - s["lo"]) and (s["hi"] - s["lo"]) / buckets > 0]
        if not todo:
            break
        # 1) one pass: an equal-width histogram (count, min, max) of every
        #    distinct open bracket (a column's quantiles start out sharing
        #    one) -- a hash aggregate combined in each task, so the shuffle
        #    carries at most brackets x buckets rows per task
        keys = list(dict.fromkeys((s["c"], s["lo"], s["hi"]) for s in todo))
        gid = {key: g for g, key in enumerate(keys)}
        long = members(keys, buckets)
        hist = long.groupBy("g", "b").agg(F.count(F.lit(1)).alias("cnt"), F.min("x").alias("vmin"),
                                          F.max("x").alias("vmax"))
        # 2) running counts per bracket (at most ``buckets`` rows each) and the
        #    one or two buckets that hold ranks r0 / r1: O(targets) rows back
        meta = spark.createDataFrame(
            [(j, gid[(s["c"], s["lo"], s["hi"])], s["below"], s["r0"], s["r1"]) for j, s in enumerate(todo)],
            "k int, g int, below long, r0 long, r1 long")
        w = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hits = (hist.withColumn("upto", F.sum("cnt").over(w))
                .join(F.broadcast(meta), "g")  # meta: one row per open (column, quantile)
                .withColumn("first", F.col("below") + F.col("upto") - F.col("cnt"))
                .withColumn("last", F.col("below") + F.col("upto") - 1)
                .where((F.col("first") <= F.col("r1")) & (F.col("last") >= F.col("r0")))
                .select("k", "b", "first", "last", "vmin", "vmax").collect())
        found: dict = {}
        for r in hits:
            found.setdefault(r["k"], []).append(r)
        for j, s in enumerate(todo):
            rs = sorted(found[j], key=lambda r: r["b"])
            if len(rs) == 2:
                # r1 = r0 + 1 in the next non-empty bucket: r0 is the last value
                # of its bucket and r1 the first of the next
                s.update(v0=rs[0]["vmax"], v1=rs[1]["vmin"])
            elif rs[0]["vmin"] == rs[0]["vmax"]:
                s.update(v0=rs[0]["vmin"], v1=rs[0]["vmin"])
            else:
                r = rs[0]
                s.update(lo=r["vmin"], hi=r["vmax"], below=r["first"], inside=r["last"] - r["first"] + 1)
    return _select(st, spark, members, kind)


def _finite_brackets(df, st) -> None:
    """Columns with an infinite min or max: one pass counts the -inf / +inf
    values and finds the finite min / max, so every bracket starts finite.
    Ranks inside the infinite runs are pinned at once."""
    cols = list(dict.fromkeys(s["c"] for s in st if s["n"] > 0 and not math.isfinite(s["hi"] - s["lo"])))
    if not cols:
        return
    inf = float("inf")
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        fin = F.when((x > -inf) & (x < inf), x)
        aggs += [F.count_if(x == -inf).alias(f"neg{i}"), F.count_if(x == inf).alias(f"pos{i}"),
                 F.min(fin).alias(f"fmin{i}"), F.max(fin).alias(f"fmax{i}")]
    r = df.agg(*aggs).first()
    for s in st:
        if s["n"] > 0 and s["c"] in cols:
            i = cols.index(s["c"])
            _pin(s, r[f"neg{i}"], r[f"pos{i}"], r[f"fmin{i}"], r[f"fmax{i}"])


def _pin(s, neg, pos, fmin, fmax) -> None:
    """Ranks among ``neg`` / ``pos`` infinite values are known; the others' bracket is finite."""
    nfin, inf = s["n"] - neg - pos, float("inf")

    def at(rank):  # the value at a rank inside an infinite run, else None
        if rank < neg:
            return -inf
        if rank >= neg + nfin:
            return inf
        return None
    v0, v1 = at(s["r0"]), at(s["r1"])
    if v0 is not None and v1 is None:
        v1 = fmin  # r1 = r0 + 1 is the first finite value
    elif v0 is None and v1 is not None:
        v0 = fmax  # r0 = r1 - 1 is the last finite value
    if v0 is not None:
        s.update(v0=v0, v1=v1)
    else:
        s.update(lo=fmin, hi=fmax, below=neg, inside=nfin)


def _select(st, spark, members, kind) -> DataFrame:
    """Exact selection of ranks r0 / r1 inside each (bounded) bracket."""
    live = [s for s in st if s["n"] > 0 and "v0" not in s]
    rows = [(s["c"], s["p"], None) for s in st if s["n"] == 0]
    for s in st:
        if "v0" in s:  # both ranks already pinned by a histogram pass
            h = (s["n"] - 1) * s["p"]
            v = s["v0"] if s["v0"] == s["v1"] else s["v0"] + (h - math.floor(h)) * (s["v1"] - s["v0"])
            rows.append((s["c"], s["p"], None if math.isnan(v) else v))  # between an infinite and another value
    empty = spark.createDataFrame(rows, f"key {kind}, prob double, value double")
    if not live:
        return empty
    keys = list(dict.fromkeys((s["c"], s["lo"], s["hi"]) for s in live))
    per_value = members(keys).groupBy("g", F.col("x").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    meta = spark.createDataFrame(
        [(k, keys.index((s["c"], s["lo"], s["hi"])), s["c"], s["p"], s["below"], s["r0"], s["r1"], s["n"]) for k, s in enumerate(live)],
        f"k int, own int, key {kind}, prob double, below long, r0 long, r1 long, n long")
    w = Window.partitionBy("g").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (per_value.withColumn("upto", F.sum("cnt").over(w))
              .join(F.broadcast(meta), F.col("g") == F.col("own"))  # meta: one row per (column, quantile)
              .withColumn("first", F.col("below") + F.col("upto") - F.col("cnt"))
              .withColumn("last", F.col("below") + F.col("upto") - 1))
    picked = ranked.groupBy("k", "key", "prob", "r0", "r1", "n").agg(
        F.max(F.when((F.col("first") <= F.col("r0")) & (F.col("r0") <= F.col("last")), F.col("value"))).alias("v0"),
        F.max(F.when((F.col("first") <= F.col("r1")) & (F.col("r1") <= F.col("last")), F.col("value"))).alias("v1"))
    h = (F.col("n") - 1) * F.col("prob")
    frac = h - F.floor(h)
    value = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(F.col("v0") + frac * (F.col("v1") - F.col("v0")))
    return picked.select("key", "prob", F.nanvl(value, F.lit(None).cast("double")).alias("value")).unionByName(empty)
