"""Tail probabilities as column expressions: normal, chi-square and F.

The regularised incomplete gamma and beta functions are a power series or a continued
fraction (modified Lentz), folded with ``aggregate`` over as many terms as the parameters
ask for (a multiple of their square root).  What stands before them is written with
Stirling's error and the deviance ``x ln(x / m) + m - x``, so that degrees of freedom of
10^11 keep their digits.  They are meant for tables with a row a column or a test.

``log_normal_sf`` is meant for every value of a column: polynomials, fitted when the module
is first used, of ln(erfcx) in t = 2 / (2 + x) on sixteen intervals.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' approximation of the gamma function for g = 7
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# Coefficients of 1/z, 1/z^3, ... of Stirling's series
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
TINY = 1e-300
INTERVALS, DEGREE = 16, 12


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x >= 0.5."""
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        s = s + F.lit(c) / (x + i)
    t = x + 6.5
    return HALF_LOG_2PI + (x - 0.5) * F.log(t) - t + F.log(s)


def stirling_error(z: Column) -> Column:
    """ln gamma(z) less Stirling's formula, for z >= 0.5."""
    series = F.lit(0.0)
    for c in reversed(STIRLING):
        series = series / (z * z) + c
    return F.when(z >= 15, series / z).otherwise(log_gamma(z) - ((z - 0.5) * F.log(z) - z + HALF_LOG_2PI))


def deviance(x: Column, m: Column) -> Column:
    """x ln(x / m) + m - x for positive x and m, without cancellation where they are close."""
    v = (x - m) / (x + m)
    series = F.lit(0.0)
    for j in range(10, 0, -1):
        series = (series + F.lit(1.0 / (2 * j + 1))) * v * v
    return F.when(F.abs(v) < 0.1, (x - m) * v + 2 * x * v * series).otherwise(x * F.log(x / m) + m - x)


def _terms(a: Column) -> Column:
    return (60 + 12 * F.sqrt(a)).cast("int")


def _kept(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _lentz(count: Column, steps, c0: float, d0: Column) -> Column:
    """A continued fraction by modified Lentz; ``steps(i)`` gives the (numerator, denominator)
    pairs of round i, ``c0`` and ``d0`` start the ratios."""
    def step(acc, i):
        c, d, h = acc["c"], acc["d"], acc["h"]
        for num, den in steps(i.cast("double")):
            d = 1.0 / _kept(den + num * d)
            c = _kept(den + num / c)
            h = h * c * d
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    return F.aggregate(F.sequence(F.lit(1), count), F.struct(F.lit(c0).alias("c"), d0.alias("d"), d0.alias("h")), step)["h"]


def gamma_q(a: Column, x: Column) -> Column:
    """The upper regularised incomplete gamma function for a >= 0.5, x >= 0."""
    front = F.exp(-stirling_error(a) - deviance(a, x)) / F.sqrt(2 * math.pi * a)  # x^a e^-x / gamma(a + 1)
    series = F.aggregate(F.sequence(F.lit(1), _terms(a)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda acc, i: F.struct(
        (acc["t"] * x / (a + i)).alias("t"), (acc["s"] + acc["t"] * x / (a + i)).alias("s")))["s"]
    fraction = _lentz(_terms(a), lambda i: [(-i * (i - a), x + 1 - a + 2 * i)], 1 / TINY, 1.0 / _kept(x + 1 - a))
    return (F.when(x.isNull() | a.isNull(), F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)).when(x == float("inf"), F.lit(0.0))
            .when(x < a + 1, F.greatest(1.0 - front * series, F.lit(0.0))).otherwise(front * a * fraction))


def beta_i(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The regularised incomplete beta function for a, b >= 0.5; y is 1 - x, given apart to keep
    its digits.  For a of 10^7 or more, and 10^4 times b, the continued fraction would cancel;
    there the first term of the expansion in gamma functions is exact to about (b / a)^2."""
    n = a + b
    front = F.sqrt(a * b / (2 * math.pi * n)) * F.exp(
        stirling_error(n) - stirling_error(a) - stirling_error(b) - deviance(a, n * x) - deviance(b, n * y))

    def fraction(a, b, x):
        d = 1.0 / _kept(1.0 - n * x / (a + 1))
        steps = lambda i: [(i * (b - i) * x / ((a - 1 + 2 * i) * (a + 2 * i)), F.lit(1.0)),
                           (-(a + i) * (n + i) * x / ((a + 2 * i) * (a + 1 + 2 * i)), F.lit(1.0))]
        return _lentz(_terms(F.greatest(a, b)), steps, 1.0, d)

    return (F.when(x.isNull() | a.isNull() | b.isNull(), F.lit(None).cast("double")).when(x <= 0, F.lit(0.0)).when(y <= 0, F.lit(1.0))
            .when((a >= 1e7) & (a >= 1e4 * b), gamma_q(b, -(a + (b - 1) / 2) * F.log1p(-y)))
            .when(x < (a + 1) / (n + 2), front / a * fraction(a, b, x)).otherwise(1.0 - front / b * fraction(b, a, y)))


def chi_square_sf(x: Column, dof: Column) -> Column:
    """Probability of a chi-square value of at least x; NULL without degrees of freedom."""
    return F.when(dof >= 1, gamma_q(dof / 2, x / 2))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """Probability of an F value of at least f; NULL without degrees of freedom."""
    whole = d2 + d1 * f
    inside = beta_i(d2 / 2, d1 / 2, d2 / whole, d1 * f / whole)
    return F.when((d1 >= 1) & (d2 >= 1), F.when(f == float("inf"), F.lit(0.0)).when(f <= 0, F.lit(1.0)).otherwise(inside))


def normal_sf(z: Column) -> Column:
    return F.exp(log_normal_sf(z))


def _erfcx(x: float) -> float:
    """exp(x^2) erfc(x) for x >= 0."""
    if x < 5:
        return math.exp(x * x) * math.erfc(x)
    tail = x
    for k in range(60, 0, -1):
        tail = x + 0.5 * k / tail
    return 1 / (math.sqrt(math.pi) * tail)


@lru_cache
def _pieces() -> list[list[float]]:
    """Coefficients of ln(erfcx(x) / t) in each interval's variable from -1 to 1."""
    from numpy.polynomial import chebyshev as ch
    out = []
    for i in range(INTERVALS):
        def g(u, i=i):
            ts = [(v + 1 + 2 * i) / (2 * INTERVALS) for v in u]
            return [math.log(_erfcx(2 / t - 2) / t) for t in ts]
        out.append([float(c) for c in ch.cheb2poly(ch.chebinterpolate(g, DEGREE))])
    return out


def log_normal_sf(z: Column) -> Column:
    """ln of the probability that a standard normal value exceeds z, with its digits in both tails."""
    x = F.abs(z) / math.sqrt(2)
    t = 2 / (2 + x)
    i = F.least(F.floor(t * INTERVALS), F.lit(INTERVALS - 1)).cast("int")
    u = 2 * INTERVALS * t - 1 - 2 * i
    table = F.array(*[F.array(*[F.lit(c) for c in reversed(p)]) for p in _pieces()])
    far = F.aggregate(F.get(table, i), F.lit(0.0), lambda acc, c: acc * u + c) + F.log(t / 2) - x * x
    return F.when(z >= 0, far).otherwise(F.log1p(-F.exp(far)))
