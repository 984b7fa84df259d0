"""Tail probabilities against tabulated values, closed forms and numerical integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprofile.functions import special


def integral(f, a, b, pieces=400):
    x, w = np.polynomial.legendre.leggauss(40)
    edges = np.linspace(a, b, pieces + 1)
    return sum(float(np.sum(f((hi - lo) / 2 * x + (hi + lo) / 2) * w) * (hi - lo) / 2) for lo, hi in zip(edges, edges[1:]))


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(expr).collect()]


def test_tabulated(spark):
    got = values(spark, [(3.841458820694124, 1.0), (5.991464547107979, 2.0), (18.307038053275146, 10.0), (0.0, 3.0)], "x double, k double",
                 special.chi_square_sf(F.col("x"), F.col("k")))
    assert got == pytest.approx([0.05, 0.05, 0.05, 1.0], rel=1e-10)
    got = values(spark, [(4.964602743730711, 1.0, 10.0), (161.44763879758827, 1.0, 1.0), (3.3258345304130117, 5.0, 10.0)],
                 "f double, a double, b double", special.f_sf(F.col("f"), F.col("a"), F.col("b")))
    assert got == pytest.approx([0.05] * 3, rel=1e-10)


def test_chi_square_is_the_integral(spark):
    rows = [(x * k, float(k)) for k in (1, 2, 3, 7, 50, 999, 4000) for x in (0.3, 0.9, 1.0, 1.05, 1.4)]
    got = values(spark, rows, "x double, k double", special.chi_square_sf(F.col("x"), F.col("k")))
    for (x, k), p in zip(rows, got):
        log_norm = -(k / 2) * math.log(2) - math.lgamma(k / 2)
        width = 60 * math.sqrt(2 * k) + 200
        upper = integral(lambda t: np.exp((k / 2 - 1) * np.log(t) - t / 2 + log_norm), x, max(x, k) + width)
        assert p == pytest.approx(upper, rel=1e-10 if k < 1000 else 1e-7, abs=1e-13), (x, k)  # lgamma's own digits


def test_f_closed_forms_and_integral(spark):
    rows = [(f, float(a), float(b)) for a in (1, 2, 3, 8) for b in (2, 5, 40, 900) for f in (0.2, 0.99, 1.0, 2.5, 9.0)]
    got = values(spark, rows, "f double, a double, b double", special.f_sf(F.col("f"), F.col("a"), F.col("b")))
    for (f, a, b), p in zip(rows, got):
        if a == 2:
            assert p == pytest.approx((1 + 2 * f / b) ** (-b / 2), rel=1e-10)
        x = b / (b + a * f)
        beta = math.exp(math.lgamma(a / 2) + math.lgamma(b / 2) - math.lgamma((a + b) / 2))
        # s = sqrt(1 - t) takes the root out of the integrand at t = 1
        inside = integral(lambda s: 2 * (1 - s * s) ** (b / 2 - 1) * s ** (a - 1) / beta, math.sqrt(1 - x), 1.0)
        assert p == pytest.approx(inside, rel=1e-9, abs=1e-13), (f, a, b)


def test_large_degrees_of_freedom_keep_their_digits(spark):
    got = values(spark, [(f, 2.0, 1e11) for f in (0.5, 1.0, 3.0, 20.0)], "f double, a double, b double",
                 special.f_sf(F.col("f"), F.col("a"), F.col("b")))
    assert got == pytest.approx([math.exp(-f) for f in (0.5, 1.0, 3.0, 20.0)], rel=1e-8)


def test_normal_tails(spark):
    zs = [-30.0, -8.0, -3.0, -1.0, -1e-9, 0.0, 1e-9, 0.3, 1.0, 2.5, 6.0, 8.0, 20.0, 30.0, 35.0, 60.0]
    got = values(spark, [(z,) for z in zs], "z double", special.log_normal_sf(F.col("z")))
    for z, p in zip(zs, got):
        if z < 0:
            want = math.log1p(-0.5 * math.erfc(-z / math.sqrt(2)))
        elif z < 35:
            want = math.log(0.5 * math.erfc(z / math.sqrt(2)))
        else:
            want = -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / z**2 + 3 / z**4 - 15 / z**6)
        assert p == pytest.approx(want, rel=2e-12, abs=1e-300), z
    many = np.linspace(-6, 12, 2000)
    got = values(spark, [(float(z),) for z in many], "z double", special.normal_sf(F.col("z")))
    assert got == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in many], rel=2e-11)


def test_undefined_cases(spark):
    df = spark.createDataFrame([(None, 2.0, 3.0), (1.0, 0.0, 3.0), (float("inf"), 1.0, 3.0), (0.0, 1.0, 3.0)], "f double, a double, b double")
    got = [(r[0], r[1]) for r in df.select(special.f_sf(F.col("f"), F.col("a"), F.col("b")), special.chi_square_sf(F.col("f"), F.col("a"))).collect()]
    assert got == [(None, None), (None, None), (0.0, 0.0), (1.0, 1.0)]
