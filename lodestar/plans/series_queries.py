"""Queries over daily series of orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import series as S

from .registry import query
from .tables import table


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return S.daily(table(spark, sf, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), provisional=F.col("o_orderstatus") == "P")


DAILY = """daily AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS value, bool_or(o_orderstatus = 'P') AS provisional FROM orders GROUP BY 1, 2)"""
NORMAL = """normals AS (SELECT key, month(d) AS month, day(d) AS day, CASE WHEN day(d) <> 31 THEN round(avg(value), 6) END AS normal FROM daily WHERE year(d) <= 1997 GROUP BY key, month(d), day(d))"""


def _normals(days: DataFrame) -> DataFrame:
    """Normals of the years up to 1997; the last day of long months has none, as files leave some out."""
    means = days.filter(F.year("d") <= 1997).groupBy("key", F.month("d").alias("month"), F.day("d").alias("day")).agg(r6(F.avg("value"), "normal"))
    return means.withColumn("normal", F.when(F.col("day") != 31, F.col("normal")))


@query(
    "annual_summary",
    f"""WITH {DAILY}, {NORMAL}
    SELECT a.key, CAST(year(d) AS BIGINT) AS year, round(avg(value), 3) AS mean, round(min(value), 3) AS min, round(max(value), 3) AS max, count(*) AS valid_days,
      CAST(count(*) FILTER (provisional) AS BIGINT) AS provisional_days, round(avg(value - normal), 3) AS anomaly
    FROM daily a LEFT JOIN normals n ON a.key = n.key AND month(d) = month AND day(d) = day GROUP BY 1, 2""",
)
def annual_summary(spark: SparkSession, sf: str) -> DataFrame:
    days = _orders(spark, sf)
    return S.annual_summary(days, _normals(days))


@query(
    "monthly_normals",
    f"""WITH {DAILY}, {NORMAL}, spine AS (SELECT key, CAST(m AS INTEGER) AS month FROM (SELECT DISTINCT key FROM normals), range(1, 13) t(m))
    SELECT s.key, s.month, round(avg(normal), 3) AS normal FROM spine s LEFT JOIN (SELECT * FROM normals WHERE NOT (key = '1-URGENT' AND month = 4)) n ON s.key = n.key AND s.month = n.month GROUP BY 1, 2""",
)
def monthly_normals(spark: SparkSession, sf: str) -> DataFrame:
    n = _normals(_orders(spark, sf))
    return S.monthly_normals(n.filter(~((F.col("key") == "1-URGENT") & (F.col("month") == 4))))


@query(
    "annual_normal",
    f"""WITH {DAILY}, {NORMAL}, m AS (SELECT key, month, round(avg(normal), 3) AS normal FROM normals WHERE NOT (key = '1-URGENT' AND month = 4) GROUP BY 1, 2)
    SELECT key, CASE WHEN count(normal) = 12 THEN round(avg(normal), 6) END AS annual_normal FROM m GROUP BY 1""",
)
def annual_normal(spark: SparkSession, sf: str) -> DataFrame:
    return S.annual_normal(monthly_normals(spark, sf)).select("key", r6("annual_normal", "annual_normal"))


def _yearly(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    y = df.groupBy(F.col("c_nationkey").alias("key"), F.year("o_orderdate").cast("double").alias("x")).agg(F.round(F.avg("o_totalprice"), 3).alias("y"), F.count("*").alias("n"))
    return y.filter("x < 2001 and n >= 2")


YEARLY = """yearly AS (SELECT c_nationkey AS key, CAST(year(o_orderdate) AS DOUBLE) AS x, round(avg(o_totalprice), 3) AS y, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING x < 2001 AND count(*) >= 2)"""


@query(
    "trend_by_nation",
    f"""WITH {YEARLY}, fit AS (SELECT key, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS sst FROM yearly GROUP BY 1 HAVING count(*) >= 4),
    res AS (SELECT f.key, sum((y - slope * x - intercept) ** 2) AS sse FROM yearly y JOIN fit f ON y.key = f.key GROUP BY 1)
    SELECT key, n, round(slope * 10, 4) AS slope_decade, round(sqrt(sse / (n - 2) / sxx) * 10, 4) AS se_decade, round(slope / sqrt(sse / (n - 2) / sxx), 4) AS t, round(1 - sse / sst, 4) AS r2 FROM fit JOIN res USING (key)""",
)
def trend_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    t = S.trends(_yearly(spark, sf).drop("n"), "key", "x", "y", min_points=4, with_p=False)
    return t.select("key", "n", F.round(F.col("slope") * 10, 4).alias("slope_decade"), F.round(F.col("se") * 10, 4).alias("se_decade"), F.round("t", 4).alias("t"), F.round("r2", 4).alias("r2"))


@query("trend_p_values")
def trend_p_values(spark: SparkSession, sf: str) -> DataFrame:
    """With the t distribution's tail, which SQL lacks; its values are tested against closed forms."""
    t = S.trends(_yearly(spark, sf).drop("n"), "key", "x", "y", min_points=4)
    return t.select("key", "n", r6("p", "p"), C.p_text(F.col("p")).alias("p_text"), C.signed_slope(F.col("slope")).alias("slope_text"))


@query(
    "trend_rollup",
    f"""WITH {YEARLY}, fit AS (SELECT key, count(*) AS n, round(regr_slope(y, x), 4) AS slope FROM yearly GROUP BY 1 HAVING count(*) >= 4)
    SELECT count(*) AS n_keys, CAST(count(*) FILTER (n >= 6) AS BIGINT) AS n_long, CAST(count(*) FILTER (slope > 0) AS BIGINT) AS n_rising, round(median(slope), 4) AS median_slope, round(max(slope), 4) AS max_slope FROM fit""",
)
def trend_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = S.trends(_yearly(spark, sf).drop("n"), "key", "x", "y", min_points=4, with_p=False).withColumn("slope", F.round("slope", 4))
    return t.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") >= 6).alias("n_long"), F.count_if(F.col("slope") > 0).alias("n_rising"), F.round(F.median("slope"), 4).alias("median_slope"), F.round(F.max("slope"), 4).alias("max_slope"))


@query("pearson_and_quartiles", f"WITH {YEARLY}, k AS (SELECT key, round(avg(y), 3) AS level, round(regr_slope(y, x), 4) AS slope FROM yearly GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY level, key) AS i, count(*) OVER () AS n FROM k) SELECT round(corr(level, slope), 6) AS r, round(median(CASE WHEN i <= n // 4 THEN slope END), 6) AS low, round(median(CASE WHEN i > n - n // 4 THEN slope END), 6) AS high FROM r")
def pearson_and_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    k = _yearly(spark, sf).groupBy("key").agg(F.round(F.avg("y"), 3).alias("level"), F.round(F.regr_slope("y", "x"), 4).alias("slope"))
    q = S.quartile_medians(k, "level", "slope")
    return k.agg(r6(F.corr("level", "slope"), "r")).crossJoin(q.select(r6("low", "low"), r6("high", "high")))


DOY = "(CASE WHEN month(d) = 2 AND day(d) = 29 THEN 58 ELSE dayofyear(make_date(2001, month(d), day(d))) - 1 END)"


def _clim(window: int, q: float) -> str:
    return f"""clim AS (SELECT key, CAST((({DOY} + k) % 365 + 365) % 365 AS BIGINT) AS doy, avg(value) AS mean, quantile_cont(value, {q}) AS threshold
    FROM (SELECT * FROM daily WHERE year(d) BETWEEN 1995 AND 1999), range(-{window}, {window + 1}) t(k) GROUP BY 1, 2)"""


@query("circular_climatology", f"WITH {DAILY}, {_clim(5, 0.9)} SELECT key, doy, round(mean + 2e-7, 6) AS mean, round(threshold + 2e-7, 6) AS threshold FROM clim")
def circular_climatology(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded a little off the decimal grid, on which means of 32 prices tie."""
    return S.climatology(_orders(spark, sf), 1995, 1999).select("key", "doy", r6(F.col("mean") + 2e-7, "mean"), r6(F.col("threshold") + 2e-7, "threshold"))


@query("exceedance_rate", f"WITH {DAILY}, {_clim(5, 0.9)} SELECT a.key, round(avg(CAST(value > threshold AS DOUBLE)), 6) AS rate FROM daily a JOIN clim c ON a.key = c.key AND CAST({DOY} AS BIGINT) = doy WHERE year(d) BETWEEN 1995 AND 1999 GROUP BY 1")
def exceedance_rate(spark: SparkSession, sf: str) -> DataFrame:
    days = _orders(spark, sf)
    base = days.filter(F.year("d").between(1995, 1999))
    return S.exceedance(S.with_climatology(base, S.climatology(days, 1995, 1999))).select("key", r6("rate", "rate"))


@query("exceedance_gate", f"WITH {DAILY}, {_clim(5, 0.9)}, r AS (SELECT a.key, avg(CAST(value > threshold AS DOUBLE)) AS rate FROM daily a JOIN clim c ON a.key = c.key AND CAST({DOY} AS BIGINT) = doy WHERE year(d) BETWEEN 1995 AND 1999 GROUP BY 1) SELECT round(min(rate), 6) AS least, round(max(rate), 6) AS most, bool_and(rate BETWEEN 0.05 AND 0.15) AS passed FROM r")
def exceedance_gate(spark: SparkSession, sf: str) -> DataFrame:
    days = _orders(spark, sf)
    rate = S.exceedance(S.with_climatology(days.filter(F.year("d").between(1995, 1999)), S.climatology(days, 1995, 1999)))
    return rate.agg(r6(F.min("rate"), "least"), r6(F.max("rate"), "most"), F.bool_and(F.col("rate").between(0.05, 0.15)).alias("passed"))


@query("climatology_window_error", f"WITH {DAILY}, " + ", ".join(f"c{w} AS (SELECT key, doy, mean FROM (WITH {_clim(w, 0.9)} SELECT * FROM clim))" for w in (0, 1, 5, 15)) + ", e AS (" + " UNION ALL ".join(f"SELECT {w} AS w, abs(a.mean - b.mean) AS e FROM c{w} a JOIN c0 b ON a.key = b.key AND a.doy = b.doy" for w in (1, 5, 15)) + ") SELECT CAST(w AS INTEGER) AS \"window\", round(median(e), 6) AS median, round(list_sort(list(e))[CAST(floor(count(*) * 0.95) AS INTEGER) + 1], 6) AS p95, round(max(e), 6) AS most FROM e GROUP BY 1")
def climatology_window_error(spark: SparkSession, sf: str) -> DataFrame:
    e = S.percentile_error(_orders(spark, sf), (1, 5, 15), (1995, 1999))
    return e.select("window", r6("median", "median"), r6("p95", "p95"), r6("most", "most"))


EVENTS = """hot AS (SELECT *, date_diff('day', DATE '1970-01-01', d) - row_number() OVER (PARTITION BY key ORDER BY d) AS island FROM days WHERE value > threshold),
runs AS (SELECT key, island, min(d) AS a, max(d) AS b FROM hot GROUP BY 1, 2 HAVING count(*) >= {min_days}),
marked AS (SELECT *, CASE WHEN lag(b) OVER w IS NULL OR date_diff('day', lag(b) OVER w, a) - 1 > {gap} THEN 1 ELSE 0 END AS fresh FROM runs WINDOW w AS (PARTITION BY key ORDER BY a)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY a) AS event FROM marked),
spans AS (SELECT key, event, min(a) AS start, max(b) AS "end" FROM numbered GROUP BY 1, 2),
events_ AS (SELECT s.key, start, "end", CAST(date_diff('day', start, "end") + 1 AS BIGINT) AS duration, max(value - mean) AS max_over, avg(value - mean) AS mean_over, bool_or(provisional) AS provisional
  FROM spans s JOIN days t ON s.key = t.key AND t.d BETWEEN start AND "end" GROUP BY 1, 2, 3)"""
LINES = """daily AS (SELECT l_returnflag AS key, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS value, bool_or(l_linestatus = 'O' AND l_linenumber = 7) AS provisional FROM lineitem GROUP BY 1, 2),
days AS (SELECT a.*, b.mean, b.threshold FROM daily a JOIN (SELECT key, avg(value) AS mean, quantile_cont(value, 0.5) AS threshold FROM daily GROUP BY 1) b ON a.key = b.key)"""
_OUT = 'key, start, "end", duration, round(max_over + 2e-7, 6) AS max_over, round(mean_over + 2e-7, 6) AS mean_over, provisional'


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    days = S.daily(table(spark, sf, "lineitem"), F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_quantity"), F.sum, (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7))
    return days.join(days.groupBy("key").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("threshold")), "key")


def _event_columns(e: DataFrame) -> DataFrame:
    """Rounded a little off the decimal grid, on which means of prices tie, so that the order of summing doesn't show."""
    return e.select("key", "start", "end", "duration", r6(F.col("max_over") + 2e-7, "max_over"), r6(F.col("mean_over") + 2e-7, "mean_over"), "provisional")


@query("heat_events", f"WITH {LINES}, {EVENTS.format(min_days=2, gap=1)} SELECT {_OUT} FROM events_")
def heat_events(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: daily series, percentile per key, runs, gap merge, event measures."""
    return _event_columns(S.events(_lines(spark, sf), min_days=2, max_gap=1))


@query("climatology_events", f"WITH {DAILY}, {_clim(15, 0.6)}, days AS (SELECT a.*, mean, threshold FROM daily a JOIN clim c ON a.key = c.key AND CAST({DOY} AS BIGINT) = doy), {EVENTS.format(min_days=2, gap=1)} SELECT {_OUT} FROM events_")
def climatology_events(spark: SparkSession, sf: str) -> DataFrame:
    days = _orders(spark, sf)
    return _event_columns(S.events(S.with_climatology(days, S.climatology(days, 1995, 1999, 15, 0.6)), 2, 1))


COVER = "cover AS (SELECT key, unnest(generate_series(start, \"end\", INTERVAL 1 DAY))::DATE AS d FROM events_)"


@query("period_share", f"WITH {LINES}, {EVENTS.format(min_days=2, gap=1)}, {COVER} SELECT a.key, round(avg(CASE WHEN a.d < DATE '1999-01-01' THEN CASE WHEN c.d IS NULL THEN 0.0 ELSE 1.0 END END), 6) AS before, round(avg(CASE WHEN a.d >= DATE '1999-01-01' THEN CASE WHEN c.d IS NULL THEN 0.0 ELSE 1.0 END END), 6) AS after FROM days a LEFT JOIN cover c ON a.key = c.key AND a.d = c.d GROUP BY 1")
def period_share(spark: SparkSession, sf: str) -> DataFrame:
    days = _lines(spark, sf)
    return S.period_share(days, S.events(days, 2, 1), F.col("d") >= F.lit("1999-01-01").cast("date")).select("key", r6("before", "before"), r6("after", "after"))


@query("yearly_share", f"WITH {LINES}, {EVENTS.format(min_days=2, gap=1)}, {COVER}, b AS (SELECT min(d) AS a, max(d) AS z, count(DISTINCT key) AS n FROM days), y AS (SELECT n, z, unnest(range(year(a), year(z) + 1)) AS year FROM b) SELECT CAST(y.year AS BIGINT) AS year, round(count(c.d) / (n * CASE WHEN y.year = year(z) THEN dayofyear(z) ELSE date_diff('day', make_date(y.year, 1, 1), make_date(y.year + 1, 1, 1)) END), 6) AS share FROM y LEFT JOIN cover c ON year(c.d) = y.year GROUP BY y.year, n, z")
def yearly_share(spark: SparkSession, sf: str) -> DataFrame:
    days = _lines(spark, sf)
    return S.yearly_share(days, S.events(days, 2, 1)).select("year", r6("share", "share"))


@query("region_medians", f"WITH {YEARLY}, k AS (SELECT key, regr_slope(y, x) AS slope FROM yearly GROUP BY 1) SELECT r_name AS region, CAST(count(*) AS BIGINT) AS n, round(median(slope), 6) AS median_slope FROM k JOIN nation ON key = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def region_medians(spark: SparkSession, sf: str) -> DataFrame:
    k = _yearly(spark, sf).groupBy("key").agg(F.regr_slope("y", "x").alias("slope"))
    at = k.join(table(spark, sf, "nation"), F.col("key") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return at.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"), r6(F.median("slope"), "median_slope"))


@query("sorted_trend_table", f"WITH {YEARLY}, k AS (SELECT key, round(regr_slope(y, x), 4) AS slope, CASE WHEN key % 3 <> 0 THEN round(avg(y), 3) END AS normal FROM yearly GROUP BY 1) SELECT key, slope, normal, row_number() OVER (ORDER BY slope DESC, key) AS by_slope, row_number() OVER (ORDER BY coalesce(normal, 1e99), key) AS by_normal FROM k")
def sorted_trend_table(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    k = _yearly(spark, sf).groupBy("key").agg(F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.when(F.col("key") % 3 != 0, F.round(F.avg("y"), 3)).alias("normal"))
    rank = lambda *o: F.row_number().over(Window.orderBy(*o)).cast("long")
    return k.select("key", "slope", "normal", rank(F.desc("slope"), "key").alias("by_slope"), rank(F.asc_nulls_last("normal"), "key").alias("by_normal"))


@query("sparkline_paths")
def sparkline_paths(spark: SparkSession, sf: str) -> DataFrame:
    """SVG paths: number formats differ between engines in ties, so the tests hold them against fixed values."""
    return S.sparkline(_yearly(spark, sf), "key", "x", "y", 120.0, 24.0, 2.0)


@query("complete_years", f"WITH {DAILY} SELECT key, CAST(year(d) AS BIGINT) AS year, count(*) AS valid_days FROM daily GROUP BY 1, 2 HAVING count(*) >= 40")
def complete_years(spark: SparkSession, sf: str) -> DataFrame:
    return S.complete_years(S.annual_summary(_orders(spark, sf)), 40).select("key", "year", "valid_days")


@query("event_type_days", "WITH daily AS (SELECT event_type AS key, CAST(ts AS DATE) AS d, avg(value) AS value, false AS provisional FROM events GROUP BY 1, 2), days AS (SELECT a.*, b.mean, b.threshold FROM daily a JOIN (SELECT key, avg(value) AS mean, quantile_cont(value, 0.5) AS threshold FROM daily GROUP BY 1) b ON a.key = b.key), " + EVENTS.format(min_days=2, gap=1) + f" SELECT {_OUT} FROM events_")
def event_type_days(spark: SparkSession, sf: str) -> DataFrame:
    days = S.daily(table(spark, sf, "events"), F.col("event_type"), F.col("ts"), F.col("value"))
    days = days.join(days.groupBy("key").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("threshold")), "key")
    return _event_columns(S.events(days, 2, 1))
