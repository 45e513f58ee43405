"""Daily series: annual summaries, trends, circular climatology, threshold events, shares."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestar.functions.columns import day_of_cycle

from .numbering import numbered
from .quantiles import quantiles, selected
from .stages import kept


def daily(df: DataFrame, key: Column, at: Column, value: Column, how=F.avg, provisional: Column | None = None) -> DataFrame:
    """One row per key and day: key, d, value, provisional."""
    flag = F.bool_or(provisional) if provisional is not None else F.lit(False)
    return df.groupBy(key.alias("key"), at.cast("date").alias("d")).agg(how(value).alias("value"), flag.alias("provisional"))


def annual_summary(days: DataFrame, normals: DataFrame | None = None, digits: int = 3) -> DataFrame:
    """key, year, mean, min, max, valid_days, provisional_days, anomaly (mean of daily differences from (key, month, day) normals)."""
    if normals is not None:
        days = days.join(normals.select("key", "month", "day", "normal"), (days["key"] == normals["key"]) & (F.month("d") == normals["month"]) & (F.day("d") == normals["day"]), "left").select(days["*"], "normal")
    else:
        days = days.withColumn("normal", F.lit(None).cast("double"))
    return days.groupBy("key", F.year("d").cast("long").alias("year")).agg(
        F.round(F.avg("value"), digits).alias("mean"), F.round(F.min("value"), digits).alias("min"), F.round(F.max("value"), digits).alias("max"),
        F.count("*").alias("valid_days"), F.count_if("provisional").alias("provisional_days"), F.round(F.avg(F.col("value") - F.col("normal")), digits).alias("anomaly"),
    )


def monthly_normals(normals: DataFrame, digits: int = 3) -> DataFrame:
    """key, month 1 to 12, mean normal; null where a month has none."""
    keys = normals.select("key").distinct()
    spine = keys.select("key", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    means = normals.groupBy("key", F.col("month").cast("int").alias("month")).agg(F.round(F.avg("normal"), digits).alias("normal"))
    return spine.join(means, ["key", "month"], "left")


def annual_normal(monthly: DataFrame) -> DataFrame:
    """key, mean of the twelve months; null unless all are there."""
    return monthly.groupBy("key").agg(F.when(F.count("normal") == 12, F.avg("normal")).alias("annual_normal"))


def t_tail(t: float, nu: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function by its continued fraction."""
    if math.isinf(t):
        return 0.0
    x, a, b = nu / (nu + t * t), nu / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, nu: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or math.isnan(x) else t_tail(abs(x), n) for x, n in zip(t, nu, strict=True)], dtype="float64")


def trends(points: DataFrame, key: str, x: str, y: str, min_points: int = 10, with_p: bool = True, strict: bool = False) -> DataFrame:
    """Least squares per key: n, slope, intercept, sse, se, t, p (two-sided), r2; keys with too few points go, or with ``strict`` raise.

    se is infinite-safe: t is infinite where the fit is exact, r2 null where y is constant.
    """
    fit = points.groupBy(key).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("sst"))
    enough = F.col("n") >= min_points
    fit = fit.filter(F.when(enough, True).otherwise(F.raise_error(F.concat(F.col(key).cast("string"), F.lit(" has "), F.col("n").cast("string"), F.lit(" points"))))) if strict else fit.filter(enough)
    res = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    sse = points.join(fit, key).groupBy(key).agg(F.sum(res * res).alias("sse"))
    out = fit.join(sse, key).withColumn("se", F.sqrt(F.col("sse") / (F.col("n") - 2) / F.col("sxx")))
    out = out.withColumn("t", F.when(F.col("se") > 0, F.col("slope") / F.col("se")).otherwise(F.lit(float("inf"))))
    out = out.withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")))
    return out.withColumn("p", t_p_value("t", (F.col("n") - 2).cast("double"))) if with_p else out


def trends_by_moments(points: DataFrame, key: str, x: str, y: str, min_points: int = 10) -> DataFrame:
    """key, n, slope, intercept, se a second way: sums of products around each key's means, residuals from them instead of from the rows. Keys with too few points go."""
    both = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = both.groupBy(key).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    a, b = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    m = both.join(means, key).groupBy(key, "mx", "my").agg(F.count("*").alias("n"), F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb")).filter((F.col("n") >= min_points) & (F.col("aa") > 0))
    slope = F.col("ab") / F.col("aa")
    left = F.greatest(F.lit(0.0), F.col("bb") - slope * F.col("ab"))
    return m.select(key, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.sqrt(left / (F.col("n") - 2) / F.col("aa")).alias("se"))


def agreeing(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row: n keys of either, how many of them are in both with every column within ``tolerance`` of its size (of 1, if that is larger), whether all are."""
    near = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"a.{c}")))
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    ok = reduce(lambda p, q: p & q, [F.coalesce(near(c), F.lit(False)) for c in columns])
    return both.agg(F.count("*").alias("n"), F.count_if(ok).alias("agree")).withColumn("passed", F.col("n") == F.col("agree"))


def climatology(days: DataFrame, first_year: int, last_year: int, window: int = 5, q: float = 0.9, cycle: int = 365, most: int = 100_000) -> DataFrame:
    """key, doy, mean, threshold over the days of the base years within ``window`` days of the year, which is a circle.

    Each day is dealt to the 2 * window + 1 days of the year that it counts for: an equi-aggregation instead of a range that can't wrap. Keys whose days
    of the year may hold many values get their quantiles with bounded state (see quantiles).
    """
    base = days.filter(F.year("d").between(first_year, last_year))
    fan = base.select("key", "value", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("k"), "d")
    fan = fan.select("key", "value", F.pmod(day_of_cycle(F.col("d")) + F.col("k"), F.lit(cycle)).cast("long").alias("doy"))
    # No day of the year holds more than its key's base rows; where that is few, the builtin does it in the same pass.
    if base.groupBy("key").count().filter(F.col("count") > most).isEmpty():
        return fan.groupBy("key", "doy").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(q)).alias("threshold"))
    means = fan.groupBy("key", "doy").agg(F.avg("value").alias("mean"))
    return means.join(quantiles(fan, ["key", "doy"], "value", [q], most).withColumnRenamed("q0", "threshold"), ["key", "doy"])


def with_climatology(days: DataFrame, clim: DataFrame) -> DataFrame:
    return days.withColumn("doy", day_of_cycle(F.col("d"))).join(clim, ["key", "doy"])


def exceedance(days: DataFrame) -> DataFrame:
    """key, rate of days strictly above the threshold."""
    return days.groupBy("key").agg(F.avg((F.col("value") > F.col("threshold")).cast("double")).alias("rate"))


def events(days: DataFrame, min_days: int = 5, max_gap: int = 2) -> DataFrame:
    """Events of (key, d, value, mean, threshold, provisional): key, start, end, duration, max_over, mean_over, provisional.

    Runs are consecutive calendar days strictly above the threshold; those shorter than ``min_days`` go before runs with at most
    ``max_gap`` days between them merge. Measures are over all observed days of the span, gap days too. Days
    of spans are matched by equality, not by range.
    """
    by_day = Window.partitionBy("key").orderBy("d")
    hot = days.filter(F.col("value") > F.col("threshold")).withColumn("island", F.unix_date("d") - F.row_number().over(by_day))
    runs = hot.groupBy("key", "island").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("n")).filter(F.col("n") >= min_days)
    by_start = Window.partitionBy("key").orderBy("start")
    gap = F.date_diff("start", F.lag("end").over(by_start)) - 1
    runs = runs.withColumn("new", (gap.isNull() | (gap > max_gap)).cast("int")).withColumn("event", F.sum("new").over(by_start))
    spans = runs.groupBy("key", "event").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    inside = spans.withColumn("d", F.explode(F.sequence("start", "end", F.expr("interval 1 day")))).join(days, ["key", "d"])
    over = F.col("value") - F.col("mean")
    found = inside.groupBy("key", "start", "end").agg(F.max(over).alias("max_over"), F.avg(over).alias("mean_over"), F.bool_or("provisional").alias("provisional"))
    return found.withColumn("duration", (F.date_diff("end", "start") + 1).cast("long"))


def normal_gate(clim: DataFrame, normals: DataFrame, usual: float, most: float) -> DataFrame:
    """One row: median and largest distance of the climatology's means from published normals (key, doy, normal), as shares of these, and whether both are within bounds."""
    off = clim.join(normals, ["key", "doy"]).select(F.lit(1).alias("one"), (F.abs(F.col("mean") - F.col("normal")) / F.abs("normal")).alias("e"))
    return quantiles(off, ["one"], "e", [0.5, 1.0]).select(F.col("q0").alias("median"), F.col("q1").alias("most"), ((F.col("q0") <= usual) & (F.col("q1") <= most)).alias("passed"))


def complete_years(summary: DataFrame, least: int, some_go: bool = False) -> DataFrame:
    """Rows of an annual summary with at least so many valid days. Raises if none is left, and with ``some_go`` if none went, when a running year must be among them."""
    n = summary.agg(F.count("*").alias("n"), F.count_if(F.col("valid_days") >= least).alias("kept")).first()
    if not n.kept:
        raise ValueError(f"no year has {least} days")
    if some_go and n.kept == n.n:
        raise ValueError(f"all years have {least} days")
    return summary.filter(F.col("valid_days") >= least)


def heat_expectations(days: DataFrame, found: DataFrame, groups: dict[str, tuple[str, ...]], span: tuple[str, str], least_days: int, least_keys: int, split: Column, share_name: str) -> DataFrame:
    """name, observed, held of predictions about events: for each group of keys how many have ``least_days`` event days within ``span``, which holds from ``least_keys`` on; and for
    ``share_name`` how many keys have a larger share of event days after the split than before, which holds for more than half of them."""
    inside = covered_days(found).filter(F.col("d").between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))).groupBy("key").agg(F.count("*").alias("n"))
    member = days.sparkSession.createDataFrame([(g, k) for g, ks in groups.items() for k in ks], "name string, key string")
    met = member.join(inside, "key", "left").groupBy("name").agg(F.count_if(F.coalesce("n", F.lit(0)) >= least_days).alias("observed"))
    share = period_share(days, found, split).agg(F.lit(share_name).alias("name"), F.count_if(F.col("after") > F.col("before")).alias("observed"), (F.count_if(F.col("after") > F.col("before")) * 2 > F.count("*")).alias("held"))
    return met.withColumn("held", F.col("observed") >= least_keys).unionByName(share)


def covered_days(found: DataFrame) -> DataFrame:
    """key, d of all days of events."""
    return found.select("key", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("d"))


def period_share(days: DataFrame, found: DataFrame, split: Column) -> DataFrame:
    """key, share of observed days in events before and after a split; null where a period has no days."""
    inside = covered_days(found).withColumn("hit", F.lit(1.0))
    both = days.join(inside, ["key", "d"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    return both.groupBy("key").agg(F.avg(F.when(~split, F.col("hit"))).alias("before"), F.avg(F.when(split, F.col("hit"))).alias("after"))


def yearly_share(days: DataFrame, found: DataFrame) -> DataFrame:
    """year, event days over (keys * calendar days); the last year ends at the last observation."""
    bounds = days.agg(F.min("d").alias("a"), F.max("d").alias("b"), F.countDistinct("key").alias("n_keys"))
    years = bounds.select("n_keys", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("year"))
    size = F.when(F.col("year") == F.year("b"), F.dayofyear("b")).otherwise(F.date_diff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1))))
    n = covered_days(found).groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"))
    return years.join(n, "year", "left").select(F.col("year").cast("long").alias("year"), (F.coalesce("n", F.lit(0)) / (F.col("n_keys") * size)).alias("share"))


def quartile_medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """Medians of the first and the last floor(n / 4) rows in order of ``by``: one row."""
    ranked = numbered(df, by).crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))
    q = F.floor(F.col("n") / 4)
    return ranked.agg(F.median(F.when(F.col("i") <= q, F.col(value))).alias("low"), F.median(F.when(F.col("i") > F.col("n") - q, F.col(value))).alias("high"))


def percentile_error(days: DataFrame, windows: tuple[int, ...], years: tuple[int, int]) -> DataFrame:
    """window, median, 95th (the element at floor(0.95 n)) and largest difference between the windowed mean and the plain daily mean."""
    plain = climatology(days, *years, window=0).select("key", "doy", F.col("mean").alias("plain"))
    parts = [climatology(days, *years, window=w).join(plain, ["key", "doy"]).select(F.lit(w).alias("window"), F.abs(F.col("mean") - F.col("plain")).alias("e")) for w in windows]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = kept(both)
    sizes = both.groupBy("window").agg(F.count("*").alias("n"), F.max("e").alias("most"))
    p95 = selected(both, ["window"], "e", sizes.select("window", F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1).alias("rank"))).select("window", F.col("value").alias("p95"))
    return quantiles(both, ["window"], "e", [0.5]).withColumnRenamed("q0", "median").join(p95, "window").join(sizes.drop("n"), "window")


def sparkline(points: DataFrame, key: str, x: str, y: str, width: float, height: float, pad: float) -> DataFrame:
    """key, an SVG path scaled to a box: one decimal, an empty path below two points."""
    w = Window.partitionBy(key)
    span = lambda c: F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(1e-12))
    at = points.withColumn("px", F.lit(pad) + (F.col(x) - F.min(x).over(w)) / span(x) * (width - 2 * pad)).withColumn("py", F.lit(height - pad) - (F.col(y) - F.min(y).over(w)) / span(y) * (height - 2 * pad))
    part = F.transform(F.array_sort(F.collect_list(F.struct(x, F.format_string("%.1f,%.1f", "px", "py").alias("s")))), lambda p: p["s"])
    return at.groupBy(key).agg(F.when(F.count("*") < 2, "").otherwise(F.concat(F.lit("M"), F.array_join(part, " L"))).alias("path"))

