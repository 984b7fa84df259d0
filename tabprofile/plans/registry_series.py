"""Registered queries of the time-series operators over ``events``, one series an event type, of texts and categories, with
their DuckDB twins (windows over whole series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprofile.operators import encode, terms, timeseries
from tabprofile.plans.registry import _union_sql, query, read, rounded

SERIES_SQL = """SELECT event_type AS k, epoch_us(ts) / 1e6 AS t, CAST(value AS DOUBLE) AS x FROM events
WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL"""
STEPS_SQL = """SELECT k, lag(t) OVER w AS a, t AS b, t - lag(t) OVER w AS d
FROM (SELECT event_type AS k, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL) s WINDOW w AS (PARTITION BY k ORDER BY t)"""
FACTOR = 4.0


@query("q_series_gaps", f"""WITH s AS ({STEPS_SQL}), m AS (SELECT k AS mk, quantile_cont(d, 0.5) AS mid FROM s WHERE d IS NOT NULL GROUP BY k)
SELECT k AS class, round(a, 4) AS started, round(b, 4) AS ended, round(d, 4) AS seconds FROM s JOIN m ON k = mk WHERE d > {FACTOR} * mid""")
def q_series_gaps(spark, sf_dir):
    return rounded(timeseries.gaps(read(spark, sf_dir, "events"), "ts", "event_type", FACTOR), 4)


@query("q_series_intervals", f"""WITH s AS (SELECT * FROM ({STEPS_SQL}) z WHERE d IS NOT NULL), m AS (SELECT k AS mk, quantile_cont(d, 0.5) AS mid FROM s GROUP BY k)
SELECT k AS class, count(*) AS intervals, round(min(d), 4) AS shortest, round(max(mid), 4) AS typical, round(max(d), 4) AS longest,
  count(*) FILTER (d > {FACTOR} * mid) AS gaps FROM s JOIN m ON k = mk GROUP BY k""")
def q_series_intervals(spark, sf_dir):
    return rounded(timeseries.interval_summary(read(spark, sf_dir, "events"), "ts", "event_type", FACTOR), 4)


def _autocorrelation_sql(lags):
    late = ", ".join(f"lag(x - m, {k}) OVER w AS b{k}" for k in range(1, lags + 1))
    return f"WITH c AS (SELECT *, avg(x) OVER (PARTITION BY k) AS m FROM ({SERIES_SQL}) s), l AS (SELECT k, x - m AS d, {late} FROM c WINDOW w AS (PARTITION BY k ORDER BY t, x))\n" \
        + _union_sql([f"SELECT k AS class, {k} AS lag, count(b{k}) AS pairs, round(sum(d * b{k}) / sum(d * d), 8) AS autocorrelation FROM l GROUP BY k" for k in range(1, lags + 1)])


@query("q_series_autocorrelation", _autocorrelation_sql(6))
def q_series_autocorrelation(spark, sf_dir):
    """With blocks of 256 rows, so that halo rows are passed on also in small tables."""
    found = timeseries.autocorrelation(read(spark, sf_dir, "events"), "ts", "value", "event_type", lags=6, block=256)
    return rounded(found, 8, ["autocorrelation"])


LINE_SQL = f"""SELECT k, count(*) AS n, min(t) AS a, max(t) AS b, regr_slope(x, t / 86400) AS s, avg(x) + regr_slope(x, t / 86400) * (min(t) - avg(t)) / 86400 AS l, regr_r2(x, t / 86400) AS r
FROM ({SERIES_SQL}) s GROUP BY k"""


@query("q_series_trend", f"""SELECT k AS class, n, round(a, 4) AS start, round(b, 4) AS "end", round(s, 6) + 0.0 AS slope_per_day, round(l, 6) AS level, round(r, 8) AS r2 FROM ({LINE_SQL}) q""")
def q_series_trend(spark, sf_dir):
    found = rounded(timeseries.trend(read(spark, sf_dir, "events"), "ts", "value", "event_type"), 4, ["start", "end"])
    return rounded(rounded(found, 6, ["slope_per_day", "level"]), 8, ["r2"])


REST_SQL = f"SELECT s.k, t, x, a, l + q.s * (t - a) / 86400 AS line, x - (l + q.s * (t - a) / 86400) AS d FROM ({SERIES_SQL}) s JOIN ({LINE_SQL}) q ON s.k = q.k"


@query("q_series_periodogram", _union_sql([f"""SELECT k AS class, CAST({p} AS DOUBLE) AS period, round(c, 6) + 0.0 AS cosine, round(s, 6) + 0.0 AS sine, round((c * c + s * s) / 2 / v, 8) AS power
FROM (SELECT k, sum(d * cos(2 * pi() / {p} * (t - a))) / (count(*) / 2.0) AS c, sum(d * sin(2 * pi() / {p} * (t - a))) / (count(*) / 2.0) AS s, sum(d * d) / count(*) AS v
  FROM ({REST_SQL}) r GROUP BY k) q""" for p in timeseries.PERIODS]))
def q_series_periodogram(spark, sf_dir):
    found = timeseries.periodogram(read(spark, sf_dir, "events"), "ts", "value", "event_type")
    return rounded(rounded(found, 6, ["cosine", "sine"]), 8, ["power"])


@query("q_series_decompose", f"""WITH r AS (SELECT *, least(floor((t - floor(t / 86400) * 86400) / 3600), 23) AS phase FROM ({REST_SQL}) z)
SELECT k AS class, count(*) AS n, round(sum(line), 3) + 0.0 AS trend, round(sum(abs(season)), 3) AS season, round(sum(abs(d - season)), 3) AS rest
FROM (SELECT *, avg(d) OVER (PARTITION BY k, phase) AS season FROM r) q GROUP BY k""")
def q_series_decompose(spark, sf_dir):
    """Trend, daily season and rest of every row, added up by series."""
    found = timeseries.decompose(read(spark, sf_dir, "events"), "ts", "value", 86400.0, "event_type")
    return rounded(found.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("trend").alias("trend"), F.sum(F.abs("season")).alias("season"),
                                              F.sum(F.abs("rest")).alias("rest")), 3)


# ---------------------------------------------------------------- D-j texts, D-e category types
WORDS_SQL = r"""SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[ \t\n\x0b\f\r]+'), lambda w: w != '')) AS term FROM documents WHERE text IS NOT NULL"""


@query("q_frequent_terms", f"""SELECT CAST(row_number() OVER (ORDER BY count DESC, term) AS INTEGER) AS rank, * FROM (
  SELECT term, count(*) AS count, count(DISTINCT doc_id) AS documents FROM ({WORDS_SQL}) w GROUP BY term ORDER BY 2 DESC, 1 LIMIT 50) t""")
def q_frequent_terms(spark, sf_dir):
    """With summaries of 200 terms, so that they overflow in small tables, too."""
    return terms.frequent_terms(read(spark, sf_dir, "documents"), "text", 50, capacity=200)


@query("q_text_profile", r"""SELECT 'text' AS column_name, count(text) AS texts, count(*) FILTER (text = '') AS empty, CAST(min(length(text)) AS INTEGER) AS shortest,
  round(avg(length(text)), 4) AS mean_length, CAST(max(length(text)) AS INTEGER) AS longest,
  round(avg(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w != ''))), 4) AS words FROM documents
UNION ALL SELECT 'lang', count(lang), count(*) FILTER (lang = ''), CAST(min(length(lang)) AS INTEGER), round(avg(length(lang)), 4), CAST(max(length(lang)) AS INTEGER),
  round(avg(len(list_filter(regexp_split_to_array(lang, '[ \t\n\x0b\f\r]+'), lambda w: w != ''))), 4) FROM documents""")
def q_text_profile(spark, sf_dir):
    return rounded(terms.text_profile(read(spark, sf_dir, "documents"), ["text", "lang"]), 4)


CATEGORY_COLS = {"orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type", "props"]}


@query("q_saved_bytes", _union_sql([f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS levels, CAST(sum(strlen({c})) AS BIGINT) AS text_bytes,
  CAST(4 * count({c}) + (SELECT sum(strlen(v)) FROM (SELECT DISTINCT {c} AS v FROM {t}) d) AS BIGINT) AS encoded_bytes,
  CAST(sum(strlen({c})) - 4 * count({c}) - (SELECT sum(strlen(v)) FROM (SELECT DISTINCT {c} AS v FROM {t}) d) AS BIGINT) AS saved_bytes FROM {t}"""
                                    for t, cols in CATEGORY_COLS.items() for c in cols]))
def q_saved_bytes(spark, sf_dir):
    parts = [encode.saved_bytes(read(spark, sf_dir, t), cols) for t, cols in CATEGORY_COLS.items()]
    return parts[0].unionByName(parts[1])


@query("q_encode_codes", """SELECT * REPLACE (CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type) FROM events""")
def q_encode_codes(spark, sf_dir):
    """All of events with event_type as its place among the sorted types."""
    return encode.encode_categories(read(spark, sf_dir, "events"), ["event_type"]).table


@query("q_encode_round_trip", "SELECT * FROM events")
def q_encode_round_trip(spark, sf_dir):
    return encode.encode_categories(read(spark, sf_dir, "events"), ["event_type", "props"]).decode()
