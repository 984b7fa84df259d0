"""Tests of distribution and homogeneity against plain Python on awkward columns."""

import math
import random
import statistics

import numpy as np
import pytest

from tabprofile.operators import inference, quantiles

NAN = float("nan")


def rows(seed=1, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        cls = r.choice(["a", "a", "a", "b", "c", None])
        out.append((cls, r.gauss(5, 2) + (cls == "b"), float(r.randrange(6)), r.expovariate(1) if i % 4 else None, 7.0, NAN if i % 3 else 1.0 * i, i % 2 == 0))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "k string, `g.x` double, ties double, gaps double, same double, nans double, flag boolean").repartition(4)


COLS = {"g.x": 1, "ties": 2, "gaps": 3, "same": 4, "nans": 5}


def column(name, by_class=False):
    i = COLS[name]
    kept = [(r[0], r[i]) for r in rows() if r[i] is not None and r[i] == r[i]]
    return kept if by_class else [v for _, v in kept]


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_normality(df):
    found = {r["feature"]: r for r in inference.normality(df).collect()}
    assert set(found) == set(COLS)
    for name, r in found.items():
        x = sorted(column(name))
        n = len(x)
        assert r["n"] == n
        if name == "same":
            assert r["ks_stat"] is None and r["ad_p"] is None and r["normal"] is None
            continue
        mu, sd = statistics.fmean(x), statistics.stdev(x)
        f = [phi((v - mu) / sd) for v in x]
        g = [phi(-(v - mu) / sd) for v in x]
        ks = max(max((i + 1) / n - p, p - i / n) for i, p in enumerate(f))
        ad = -n - sum((2 * i + 1) * math.log(f[i]) + (2 * (n - i) - 1) * math.log(g[i]) for i in range(n)) / n
        assert r["ks_stat"] == pytest.approx(ks, rel=1e-9) and r["ad_stat"] == pytest.approx(ad, rel=1e-8, abs=1e-9)
    assert not found["ties"]["normal"] and not found["gaps"]["normal"] and found["gaps"]["ad_p"] < 1e-6


def test_normality_p_values(spark):
    """The level of both tests on normal samples, and their published critical values."""
    r = np.random.default_rng(3)
    df = spark.createDataFrame([tuple(map(float, x)) for x in r.normal(size=(60, 200))], ", ".join(f"c{i} double" for i in range(200)))
    found = inference.normality(df).collect()
    for p in ("ks_p", "ad_p"):
        low = sum(x[p] < 0.05 for x in found) / 200
        assert 0.015 <= low <= 0.10, (p, low)
    from pyspark.sql import functions as F
    table = spark.createDataFrame([(0.886 / 10, 0.752, 100), (0.805 / 10, 0.631, 100)], "d double, a double, n long")  # 5 % and 10 %
    got = table.select(inference._lilliefors_p(F.col("d"), F.col("n")), inference._anderson_p(F.col("a") / (1 + 0.0075 + 0.000225), F.col("n"))).collect()
    assert [x for r in got for x in r] == pytest.approx([0.05, 0.05, 0.1, 0.1], rel=0.15)


def ranks(x):
    order = sorted(x)
    first, count = {}, {}
    for i, v in enumerate(order):
        first.setdefault(v, i)
        count[v] = count.get(v, 0) + 1
    return [first[v] + (count[v] + 1) / 2 for v in x], count


def test_kruskal_wallis(df):
    found = {r["feature"]: r for r in inference.kruskal_wallis(df, "k").collect()}
    for name, r in found.items():
        pairs = [(k, v) for k, v in column(name, True) if k is not None]
        rank, count = ranks([v for _, v in pairs])
        n = len(pairs)
        by = {}
        for (k, _), q in zip(pairs, rank):
            by.setdefault(k, []).append(q)
        assert (r["groups"], r["n"], r["dof"]) == (len(by), n, len(by) - 1)
        fix = 1 - sum(t**3 - t for t in count.values()) / (n**3 - n)
        if fix == 0:
            assert r["h_stat"] is None and r["p_value"] is None
            continue
        h = (12 / (n * (n + 1)) * sum(sum(q)**2 / len(q) for q in by.values()) - 3 * (n + 1)) / fix
        assert r["h_stat"] == pytest.approx(h, rel=1e-9) and r["p_value"] == pytest.approx(math.exp(-h / 2), rel=1e-8)  # two degrees of freedom


def test_mann_whitney(df):
    two = df.where("k is null or k != 'c'")
    found = {r["feature"]: r for r in inference.mann_whitney(two, "k").collect()}
    for name, r in found.items():
        pairs = [(k, v) for k, v in column(name, True) if k in ("a", "b")]
        a, b = [v for k, v in pairs if k == "a"], [v for k, v in pairs if k == "b"]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)  # pairs, no ranks
        assert (r["class_a"], r["class_b"], r["n_a"], r["n_b"]) == ("a", "b", len(a), len(b)) and r["u_stat"] == pytest.approx(u)
        n, (_, count) = len(pairs), ranks([v for _, v in pairs])
        sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - sum(t**3 - t for t in count.values()) / (n * (n - 1))))
        if sd == 0:
            assert r["z"] is None and r["p_value"] is None
            continue
        z = (max(u, len(a) * len(b) - u) - len(a) * len(b) / 2 - 0.5) / sd
        assert r["z"] == pytest.approx(z, rel=1e-9) and r["p_value"] == pytest.approx(min(1, math.erfc(z / math.sqrt(2))), rel=1e-8)
    with pytest.raises(ValueError):
        inference.mann_whitney(df, "k")


@pytest.mark.parametrize("center", ["median", "mean"])
def test_levene(df, center):
    found = {r["feature"]: r for r in inference.levene(df, "k", center=center).collect()}
    for name, r in found.items():
        by = {}
        for k, v in column(name, True):
            if k is not None:
                by.setdefault(k, []).append(v)
        z = {k: [abs(v - getattr(statistics, center)(x)) for v in x] for k, x in by.items()}
        flat = [v for x in z.values() for v in x]
        between = sum(len(x) * (statistics.fmean(x) - statistics.fmean(flat))**2 for x in z.values())
        within = sum((v - statistics.fmean(x))**2 for x in z.values() for v in x)
        d1, d2 = len(by) - 1, len(flat) - len(by)
        assert (r["groups"], r["n"]) == (len(by), len(flat))
        if within < 1e-20:
            assert r["w_stat"] is None and r["p_value"] is None
            continue
        w = between / d1 / (within / d2)
        assert r["w_stat"] == pytest.approx(w, rel=1e-9) and r["p_value"] == pytest.approx((1 + 2 * w / d2) ** (-d2 / 2), rel=1e-8)  # d1 = 2
    with pytest.raises(ValueError):
        inference.levene(df, "k", center="mode")


@pytest.mark.parametrize("limit, buckets", [(200_000, 1024), (5, 4)])
def test_group_quantiles(df, limit, buckets):
    got = {(r["class"], r["column_name"], r["prob"]): r["value"]
           for r in quantiles.group_quantiles(df.select("k", "`g.x`", "ties", "gaps"), ["g.x", "ties", "gaps"], "k", [0.1, 0.5, 0.75],
                                              direct_limit=limit, buckets=buckets).collect()}
    for k in "abc":
        for name in ("g.x", "ties", "gaps"):
            x = [v for c, v in column(name, True) if c == k]
            for p in (0.1, 0.5, 0.75):
                assert got.pop((k, name, p)) == pytest.approx(np.quantile(x, p), rel=1e-12)
    assert not got


def test_group_quantiles_with_infinities(spark):
    inf = float("inf")
    data = {"a": [-inf, 1.0, 2.0, inf, inf], "b": [inf, inf], "c": [3.0, -inf]}
    df = spark.createDataFrame([(k, v) for k, x in data.items() for v in x] + [("d", None)], "k string, v double")
    got = {(r["class"], r["prob"]): r["value"] for r in quantiles.group_quantiles(df, ["v"], "k", [0.25, 0.5], direct_limit=1, buckets=4).collect()}
    assert got == {("a", 0.25): 1.0, ("a", 0.5): 2.0, ("b", 0.25): inf, ("b", 0.5): inf, ("c", 0.25): None, ("c", 0.5): None}


def test_p_values_beside_f_and_chi_square(df, spark):
    found = {r["feature"]: r for r in inference.anova_test(df, "k").collect()}
    r = found["g.x"]
    assert r["p_value"] == pytest.approx((1 + 2 * r["f_stat"] / (r["n"] - 3)) ** (-(r["n"] - 3) / 2), rel=1e-8)
    assert found["same"]["p_value"] is None
    one = inference.chi_square_test(df, "k", "ties").first()
    assert one["dof"] == 10 and 0 < one["p_value"] < 1
    x = one["chi2"] / 2
    assert one["p_value"] == pytest.approx(math.exp(-x) * sum(x**i / math.factorial(i) for i in range(5)), rel=1e-9)  # even dof
    assert inference.chi_square_test(df, "k", "same").first()["p_value"] is None


def test_no_rows_one_class_and_infinities(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert [tuple(r) for r in inference.normality(none).collect()] == [("v", 0, None, None, None, None, None)]
    assert inference.kruskal_wallis(none, "k").collect() == [] and inference.levene(none, "k").collect() == []
    one = spark.createDataFrame([("a", float(i), float("inf") if i == 3 else 1.0 * i) for i in range(9)], "k string, v double, w double")
    assert [(r["groups"], r["h_stat"], r["p_value"]) for r in inference.kruskal_wallis(one, "k").collect()] == [(1, None, None)] * 2
    assert [(r["w_stat"], r["p_value"]) for r in inference.levene(one, "k").collect()] == [(None, None)] * 2
    found = {r["feature"]: r for r in inference.normality(one).collect()}
    assert found["w"]["ks_stat"] is None and found["v"]["normal"]
    two = one.withColumn("k", one.v.cast("int") % 2)
    assert {r["feature"]: r["w_stat"] is None for r in inference.levene(two, "k").collect()} == {"v": False, "w": True}
    assert inference.normality(spark.createDataFrame([("x",)], "k string")).collect() == []


def test_local_ranks_over_batches():
    """A value whose classes lie in several batches, and a feature that goes on in the next."""
    import pyarrow as pa
    rows = [(0, 1.0, "a", 2), (0, 1.0, "b", 1), (0, 2.0, "a", 4), (0, 2.0, "b", 3), (0, 5.0, "b", 1), (1, -1.0, "a", 5), (1, 0.0, "c", 1)]
    kind = pa.schema([("f", pa.int32()), ("value", pa.float64()), ("class", pa.string()), ("c", pa.int64())])

    def found(size):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, x)) for x in rows[i:i + size]], kind) for i in range(0, len(rows), size)]
        out = {}
        for b in inference._local_ranks(iter(batches)):
            for r in b.to_pylist():
                key = (r["f"], r["first"], r["class"])
                add = (r["n"], r["r"]) if r["class"] else (r["total"], r["ties"])
                out[key] = tuple(x + y for x, y in zip(out.get(key, (0, 0.0)), add))
        return out

    # places of feature 0: 1.0 has ranks 1-3 (2), 2.0 ranks 4-10 (7), 5.0 rank 11
    want = {(0, 1.0, "a"): (6, 2 * 2 + 4 * 7.0), (0, 1.0, "b"): (5, 2 + 3 * 7 + 11.0), (0, 1.0, None): (11, 24.0 + 336),
            (1, -1.0, "a"): (5, 15.0), (1, -1.0, "c"): (1, 6.0), (1, -1.0, None): (6, 120.0)}
    assert [found(n) for n in (1, 2, 3, 7)] == [want] * 4 and list(inference._local_ranks(iter([]))) == []


def test_rank_sums_join_nothing_large(spark):
    """Ranks of many ranges, and a plan that sorts the counts once: no join on the values."""
    rows = [(i * 7919 % 1000 / 10.0, "abc"[i % 3], float(i % 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, k string, y double").repartition(6)
    sums, totals = inference._rank_sums(df, "k", ["x", "y"])
    got = {(r["feature"], r["class"]): (r["n"], r["r"]) for r in sums.collect()}
    for j, c in ((0, "x"), (2, "y")):
        order = sorted(r[j] for r in rows)
        place = {v: order.index(v) + (order.count(v) + 1) / 2 for v in set(order)}
        for k in "abc":
            own = [r[j] for r in rows if r[1] == k]
            assert got[c, k] == (len(own), pytest.approx(sum(place[v] for v in own)))
    assert {r["feature"]: (r["total"], r["ties"]) for r in totals.collect()} == {
        "x": (3000, 1000 * 24.0), "y": (3000, 4 * (750.0 ** 3 - 750))}
    assert "value" not in sums._jdf.queryExecution().optimizedPlan().toString()
