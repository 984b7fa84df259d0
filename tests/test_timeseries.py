"""Time series against plain Python and NumPy, with blocks of few rows so that halos matter."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.operators import timeseries as ts

DAY = 86400.0


def rows(seed=1):
    r = random.Random(seed)
    out = []
    for k, n in (("a", 300), ("b", 7), ("c", 1), (None, 20)):
        t = 1.7e9
        for i in range(n):
            t += r.choice([0, 60, 60, 60, 90, 60, 5000 if i % 40 == 39 else 60])
            out.append((k, t, 3 + (t - 1.7e9) / DAY * 2 + 5 * math.cos(2 * math.pi * t / 3600) + r.gauss(0, 0.5)))
    out += [("d", 100.0 + i, 4.0) for i in range(30)]
    out += [("a", None, 1.0), ("a", 1.7e9, None), ("a", 1.7e9, float("nan")), ("b", 1.7e9, float("inf"))]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "`k.k` string, t double, x double").withColumn("when", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).repartition(5)


def plain(value=True):
    by = {}
    for k, t, x in rows():
        if k is not None and t is not None and (not value or (x is not None and math.isfinite(x))):
            by.setdefault(k, []).append((t, x if value else 0.0))
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize("block", [4, 64, 8192])
def test_intervals_and_gaps(df, block):
    got = {}
    for r in ts.intervals(df, "when", "k.k", block).collect():
        got.setdefault(r["class"], []).append((r["started"], r["ended"], r["seconds"]))
    want = {k: [(a, b, b - a) for (a, _), (b, _) in zip(v, v[1:])] for k, v in plain(False).items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    found = {(r["class"], r["started"]) for r in ts.gaps(df, "t", "k.k", 10, block).collect()}
    typical = {k: float(np.median([d for _, _, d in v])) for k, v in want.items() if v}
    assert found == {(k, a) for k, v in want.items() for a, _, d in v if d > 10 * typical[k]} and len(found) >= 3
    for r in ts.interval_summary(df, "t", "k.k", 10, block).collect():
        steps = [d for _, _, d in want[r["class"]]]
        assert (r["intervals"], r["shortest"], r["typical"], r["longest"]) == (len(steps), min(steps), float(np.median(steps)), max(steps))
        assert r["gaps"] == sum(d > 10 * r["typical"] for d in steps)


@pytest.mark.parametrize("block", [5, 8192])
def test_autocorrelation(df, block):
    got = {(r["class"], r["lag"]): (r["pairs"], r["autocorrelation"]) for r in ts.autocorrelation(df, "when", "x", "k.k", 5, block).collect()}
    for k, v in plain().items():
        x = np.array([b for _, b in v])
        d = x - x.mean()
        for lag in range(1, 6):
            if len(x) <= lag:
                assert (k, lag) not in got
                continue
            pairs, r = got.pop((k, lag))
            assert pairs == len(x) - lag
            assert r is None if k == "d" else r == pytest.approx(float((d[lag:] * d[:-lag]).sum() / (d * d).sum()), rel=1e-9)
    assert not got
    with pytest.raises(ValueError):
        ts.autocorrelation(df, "when", "x", "k.k", 9, 8)


def test_trend(df):
    got = {r["class"]: r for r in ts.trend(df, "t", "x", "k.k").collect()}
    assert set(got) == set("abcd")
    for k in "abd":
        t, x = (np.array(c) for c in zip(*plain()[k]))
        slope, level = np.polyfit((t - t[0]) / DAY, x, 1)
        assert got[k]["slope_per_day"] == pytest.approx(slope, rel=1e-6, abs=1e-9) and got[k]["level"] == pytest.approx(level, rel=1e-7)
        assert (got[k]["start"], got[k]["end"], got[k]["n"]) == (t[0], t[-1], len(t))
        assert got[k]["r2"] is None if k == "d" else got[k]["r2"] == pytest.approx(np.corrcoef(t, x)[0, 1] ** 2, rel=1e-6)
    assert got["c"]["slope_per_day"] is None and got["c"]["n"] == 1


def test_planted_period_is_found_and_sums_are_numpys(df):
    periods = (600.0, 1800.0, 3600.0, 7200.0, 86400.0)
    got = {(r["class"], r["period"]): r for r in ts.periodogram(df, "t", "x", "k.k", periods).collect()}
    t, x = (np.array(c) for c in zip(*plain()["a"]))
    d = x - np.polyval(np.polyfit((t - t[0]) / DAY, x, 1), (t - t[0]) / DAY)
    for p in periods:
        w = 2 * math.pi / p * (t - t[0])
        c, s = float((d * np.cos(w)).sum() / (len(t) / 2)), float((d * np.sin(w)).sum() / (len(t) / 2))
        r = got["a", p]
        assert r["cosine"] == pytest.approx(c, abs=1e-6) and r["sine"] == pytest.approx(s, abs=1e-6)
        assert r["power"] == pytest.approx((c * c + s * s) / 2 / (d * d).mean(), rel=1e-6)
    assert got["d", 600.0]["power"] is None
    best = {r["class"]: r["period"] for r in ts.main_period(df, "t", "x", "k.k", periods).collect()}
    assert best["a"] == 3600.0 and "d" not in best


def test_decomposition_adds_up_and_takes_the_season_out(df):
    got = ts.decompose(df, "t", "x", 3600.0, "k.k", phases=12).collect()
    assert len(got) == sum(map(len, plain().values()))
    for r in got:
        assert r["trend"] + r["season"] + r["rest"] == pytest.approx(r["x"], abs=1e-9)
    a = [r for r in got if r["class"] == "a"]
    assert np.std([r["rest"] for r in a]) < 0.35 * np.std([r["x"] for r in a])
    phase = lambda r: min(int(r["t"] % 3600.0 // 300), 11)
    for p in range(12):
        left = [r["x"] - r["trend"] for r in a if phase(r) == p]
        assert all(r["season"] == pytest.approx(sum(left) / len(left), abs=1e-9) for r in a if phase(r) == p)


def test_dates_no_rows_and_no_time(spark):
    days = spark.createDataFrame([(datetime.date(2024, 1, 1) + datetime.timedelta(d),) for d in (0, 1, 2, 9)], "d date")
    assert sorted(r["seconds"] for r in ts.intervals(days, "d").collect()) == [DAY, DAY, 7 * DAY]
    none = spark.createDataFrame([], "t double, x double")
    assert ts.gaps(none, "t").collect() == [] and ts.trend(none, "t", "x").collect() == [] and ts.decompose(none, "t", "x", 60.0).collect() == []
    assert ts.autocorrelation(none, "t", "x").collect() == []
    with pytest.raises(ValueError):
        ts.trend(spark.createDataFrame([("a", 1.0)], "t string, x double"), "t", "x")
