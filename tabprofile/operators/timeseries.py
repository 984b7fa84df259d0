"""D-j: order in time: intervals and gaps, autocorrelation, trend, seasonality.

A table of (time, value) rows is a series for each class of ``by`` (or one).  Rows without time
or value are left out; rows of one time follow each other by value.  Times may be timestamps,
dates or numbers (seconds).

What depends on neighbours never needs a window over a whole series: exact global positions
(``ranks.positions``) cut each series into blocks of ``BLOCK`` rows, and the last rows of a
block are passed on to the next one (halo rows), so a window holds one block and
its halo.  Trend and Fourier sums are plain sums, merged by addition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.operators.quantiles import group_quantiles
from tabprofile.operators.ranks import positions
from tabprofile.roles import normalize, qcol
from tabprofile.sources.sinks import shared_table

BLOCK = 8192
CLASSES_BROADCAST = 100_000  # most classes whose row of facts is broadcast
PERIODS = (3600.0, 6 * 3600.0, 12 * 3600.0, 86400.0, 7 * 86400.0, 30.4375 * 86400.0, 365.25 * 86400.0)  # seconds
PHASES = 24


def _seconds(df: DataFrame, time: str) -> Column:
    kind, c = df.schema[time].dataType, qcol(time)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) / 1e6
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    if isinstance(kind, T.DateType):
        return F.unix_date(c) * 86400.0
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    raise ValueError(f"{time} ({kind.simpleString()}) is no time")


def series(df: DataFrame, time: str, value: str | None = None, by: str | None = None) -> DataFrame:
    """(class, t, x): present times in seconds and values (0 without a value column)."""
    df = normalize(df)
    x = qcol(value).cast("double") if value else F.lit(0.0)
    cls = qcol(by).cast("string") if by else F.lit("")
    return df.select(cls.alias("class"), F.nanvl(_seconds(df, time), F.lit(None)).alias("t"), x.alias("x")) \
        .where("class is not null and t is not null and x is not null and abs(x) < double('inf') and abs(t) < double('inf')")


def _beside(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the facts (own, ...) of their class; broadcast after a check of the size."""
    facts = shared_table(facts, "series-facts")
    side = F.broadcast(facts) if facts.count() <= CLASSES_BROADCAST else facts
    return rows.join(side, F.col("class") == F.col("own"))


def in_blocks(rows: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """Rows of :func:`series` with position (in their series), block and halo: the last ``reach``
    rows of each block stand in the next block, too, with halo true."""
    if not 0 < reach <= block:
        raise ValueError(f"lags must be between 1 and {block}")
    placed = positions(rows, [F.col("t"), F.col("x")], ["class"])
    own, place = F.floor(F.col("position") / block), F.col("position") % block
    copies = F.when(place >= block - reach, F.array(F.struct(own.alias("block"), F.lit(False).alias("halo")),
                                                    F.struct((own + 1).alias("block"), F.lit(True).alias("halo")))) \
        .otherwise(F.array(F.struct(own.alias("block"), F.lit(False).alias("halo"))))
    return placed.select("*", F.inline(copies))


def _order() -> Window:
    return Window.partitionBy("class", "block").orderBy("position")


def intervals(df: DataFrame, time: str, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """(class, started, ended, seconds) between neighbouring times of a series, by halo rows."""
    rows = in_blocks(series(df, time, None, by), 1, block)
    before = rows.withColumn("started", F.lag("t").over(_order()))
    return before.where("not halo and started is not null").select("class", "started", F.col("t").alias("ended"), (F.col("t") - F.col("started")).alias("seconds"))


def interval_summary(df: DataFrame, time: str, by: str | None = None, factor: float = 10.0, block: int = BLOCK) -> DataFrame:
    """``(class, intervals, shortest, typical, longest, gaps)``: the median interval, and how many
    exceed ``factor`` times it."""
    steps = shared_table(intervals(df, time, by, block), "intervals")
    typical = group_quantiles(steps, ["seconds"], "class", [0.5]).select(F.col("class").alias("own"), F.col("value").alias("typical"))
    return _beside(steps, typical).groupBy("class").agg(
        F.count(F.lit(1)).alias("intervals"), F.min("seconds").alias("shortest"), F.first("typical").alias("typical"),
        F.max("seconds").alias("longest"), F.count_if(F.col("seconds") > factor * F.col("typical")).alias("gaps"))


def gaps(df: DataFrame, time: str, by: str | None = None, factor: float = 10.0, block: int = BLOCK) -> DataFrame:
    """``(class, started, ended, seconds)`` of intervals longer than ``factor`` times the median
    one of their series."""
    steps = shared_table(intervals(df, time, by, block), "intervals")
    typical = group_quantiles(steps, ["seconds"], "class", [0.5]).select(F.col("class").alias("own"), F.col("value").alias("typical"))
    return _beside(steps, typical).where(F.col("seconds") > factor * F.col("typical")).select("class", "started", "ended", "seconds")


def autocorrelation(df: DataFrame, time: str, value: str, by: str | None = None, lags: int = 10, block: int = BLOCK) -> DataFrame:
    """``(class, lag, pairs, autocorrelation)`` for lags 1 to ``lags``, counted in rows:
    sum (x_t - m)(x_t+k - m) / sum (x_t - m)^2 with the mean m of the whole series; NULL for a
    constant series, no row where it is too short."""
    rows = shared_table(series(df, time, value, by), "series")
    facts = rows.groupBy(F.col("class").alias("own")).agg(F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))
    centred = _beside(in_blocks(rows, lags, block), facts).withColumn("d", F.when(F.col("low") < F.col("high"), F.col("x") - F.col("mean")).otherwise(F.lit(0.0)))
    late = centred.select("class", "halo", "d", *[F.lag("d", k).over(_order()).alias(f"b{k}") for k in range(1, lags + 1)]).where("not halo")
    sums = late.groupBy("class").agg(F.sum(F.col("d") * F.col("d")).alias("all"), *[F.sum(F.col("d") * F.col(f"b{k}")).alias(f"s{k}") for k in range(1, lags + 1)],
                                     *[F.count(f"b{k}").alias(f"n{k}") for k in range(1, lags + 1)])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"n{k}").alias("pairs"),
                               F.when(F.col("all") > 0, F.col(f"s{k}") / F.col("all")).alias("autocorrelation")) for k in range(1, lags + 1)])
    return sums.select("class", F.inline(cells)).where("pairs > 0")


def trend(df: DataFrame, time: str, value: str, by: str | None = None) -> DataFrame:
    """``(class, n, start, end, slope_per_day, level, r2)``: the least-squares line of value on
    time; ``level`` is the line at ``start``.  NULL where all times are equal; a
    constant value has slope 0 and no r2."""
    rows = shared_table(series(df, time, value, by), "series")
    return _lines(rows)


def _lines(rows: DataFrame) -> DataFrame:
    facts = rows.groupBy(F.col("class").alias("own")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("end"),
                                                          F.avg("t").alias("mt"), F.avg("x").alias("mx"))
    a, b = (F.col("t") - F.col("mt")) / 86400.0, F.col("x") - F.col("mx")  # about the means, so that sums keep their digits
    sums = _beside(rows, facts).groupBy("class", "n", "start", "end", "mt", "mx").agg(
        F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"))
    slope = F.when((F.col("start") < F.col("end")) & (F.col("aa") > 0), F.col("ab") / F.col("aa"))
    lines = sums.withColumn("slope_per_day", slope)
    return lines.select("class", "n", "start", "end", "slope_per_day",
                        (F.col("mx") + F.col("slope_per_day") * (F.col("start") - F.col("mt")) / 86400.0).alias("level"),
                        F.when(F.col("bb") > 0, F.col("slope_per_day") * F.col("ab") / F.col("bb")).alias("r2"))


def _detrended(rows: DataFrame) -> DataFrame:
    """Rows of :func:`series` with trend (the line of their series; its mean without one)."""
    facts = _lines(rows).select(F.col("class").alias("own"), "start", "slope_per_day", "level", )
    means = rows.groupBy(F.col("class").alias("k")).agg(F.avg("x").alias("mx"))
    facts = facts.join(means, F.col("own") == F.col("k")).drop("k")
    line = F.coalesce(F.col("level") + F.col("slope_per_day") * (F.col("t") - F.col("start")) / 86400.0, F.col("mx"))
    return _beside(rows, facts).select("class", "t", "x", "start", line.alias("trend"))


def periodogram(df: DataFrame, time: str, value: str, by: str | None = None, periods=PERIODS) -> DataFrame:
    """``(class, period, cosine, sine, power)`` of the values less their trend for each period (in
    seconds): Fourier sums over all rows, which tasks add up apart, divided by n / 2; ``power``
    is (cosine^2 + sine^2) / 2 over the variance, near 1 for a pure wave of that period."""
    rows = _detrended(shared_table(series(df, time, value, by), "series")).withColumn("d", F.col("x") - F.col("trend"))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col("d") * F.col("d")).alias("dd")]
    for i, p in enumerate(periods):
        angle = F.lit(2 * math.pi / p) * (F.col("t") - F.col("start"))
        aggs += [F.sum(F.col("d") * F.cos(angle)).alias(f"c{i}"), F.sum(F.col("d") * F.sin(angle)).alias(f"s{i}")]
    sums = rows.groupBy("class").agg(*aggs)
    half = F.col("n") / 2
    cells = F.array(*[F.struct(F.lit(float(p)).alias("period"), (F.col(f"c{i}") / half).alias("cosine"), (F.col(f"s{i}") / half).alias("sine"))
                      for i, p in enumerate(periods)])
    wide = sums.select("class", F.when(F.col("dd") > 0, F.col("dd") / F.col("n")).alias("variance"), F.inline(cells))
    return wide.select("class", "period", "cosine", "sine",
                       ((F.col("cosine") * F.col("cosine") + F.col("sine") * F.col("sine")) / 2 / F.col("variance")).alias("power"))


def main_period(df: DataFrame, time: str, value: str, by: str | None = None, periods=PERIODS) -> DataFrame:
    """``(class, period, power)``: the period of greatest power of each series (ties: the shortest)."""
    best = F.max(F.struct("power", (-F.col("period")).alias("p"))).alias("b")
    return periodogram(df, time, value, by, periods).where("power is not null").groupBy("class").agg(best) \
        .select("class", (-F.col("b.p")).alias("period"), "b.power")


def decompose(df: DataFrame, time: str, value: str, period: float, by: str | None = None, phases: int = PHASES) -> DataFrame:
    """``(class, t, x, trend, season, rest)`` of every row: the line of its series, the mean of what is
    left at its phase of ``period`` (seconds, in ``phases`` equal parts), and the remainder."""
    rows = _detrended(shared_table(series(df, time, value, by), "series"))
    phase = F.least(F.floor(F.pmod(F.col("t"), F.lit(float(period))) / F.lit(period / phases)), F.lit(phases - 1))
    rows = rows.withColumn("phase", phase.cast("int"))
    season = rows.groupBy(F.col("class").alias("own2"), F.col("phase").alias("at")).agg(F.avg(F.col("x") - F.col("trend")).alias("season"))
    season = shared_table(season, "season")  # classes x phases
    side = F.broadcast(season) if season.count() <= CLASSES_BROADCAST else season
    both = rows.join(side, (F.col("class") == F.col("own2")) & (F.col("phase") == F.col("at")))
    return both.select("class", "t", "x", "trend", "season", (F.col("x") - F.col("trend") - F.col("season")).alias("rest"))
