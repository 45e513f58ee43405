"""Order statistics and quantiles against sorting, with a hot key, outliers, ties and few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import quantiles as Q
from lodestar.operators import series as S


def rows():
    rng = random.Random(5)
    out = [("hot", rng.gauss(0, 1) * 10 ** rng.randrange(-3, 4)) for _ in range(20_000)] + [("hot", 7.0)] * 5000 + [("hot", -1.7e308), ("hot", 1.7e308), ("hot", None), ("hot", float("nan"))]
    out += [("ties", float(rng.randrange(3))) for _ in range(4000)] + [("one", 3.5), ("none", None)]
    return out + [(f"k{i}", rng.random()) for i in range(40) for _ in range(1 + i % 7)]


def by_key(data):
    out = {}
    for k, v in data:
        if v is not None and v == v:
            out.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in out.items()}


def test_selected_equals_sorting(spark):
    data = rows()
    df = spark.createDataFrame(data, "key string, value double").repartition(6)
    known = by_key(data)
    wanted = [(k, r) for k, v in known.items() for r in {0, len(v) // 3, len(v) // 2, len(v) - 1, len(v)}]
    got = {(r.key, r["rank"]): r["value"] for r in Q.selected(df, ["key"], "value", spark.createDataFrame(wanted, "key string, rank long"), few=10).collect()}
    assert got == {(k, r): known[k][r] for k, r in wanted if r < len(known[k])}


def test_quantiles_equal_percentile_for_hot_keys(spark):
    data = [(k, v) for k, v in rows() if v is None or abs(v) < 1e300 or v != v]
    df = spark.createDataFrame(data, "key string, value double").repartition(6)
    both = [{r.key: (r.q0, r.q1, r.q2) for r in Q.quantiles(df, ["key"], "value", [0.5, 0.9, 0.333], most).collect()} for most in (100_000, 500)]
    assert both[0].keys() == both[1].keys() == by_key(data).keys()
    for k, v in by_key(data).items():
        assert both[1][k] == both[0][k] == pytest.approx(tuple(np.quantile(v, [0.5, 0.9, 0.333])), rel=1e-9)


def test_hot_key_is_counted_where_its_rows_are(spark):
    df = spark.createDataFrame(rows(), "key string, value double")
    plan = Q.quantiles(df, ["key"], "value", [0.9], 500)._jdf.queryExecution().toString()
    assert "percentile" in plan
    found = Q.selected(df.filter("key = 'hot'"), ["key"], "value", spark.createDataFrame([("hot", 12_345)], "key string, rank long"), few=1)
    assert found.count() == 1


def test_climatology_is_the_same_with_bounded_state(spark):
    days = spark.createDataFrame([(k, d) for k in range(2) for d in range(3000)], "key int, n int").select(F.col("key"), F.date_add(F.lit("1990-01-01").cast("date"), F.col("n")).alias("d"), (F.sin(F.col("n") / 58) * 10 + F.col("n") * 7919 % 97 / 30 + F.col("key")).alias("value"))
    whole, bounded = ({(r.key, r.doy): (r["mean"], r.threshold) for r in S.climatology(days, 1990, 1998, most=m).collect()} for m in (100_000, 50))
    assert whole.keys() == bounded.keys() and len(whole) == 730
    assert all(bounded[k] == pytest.approx(v, rel=1e-12) for k, v in whole.items())


def test_trends_can_insist_on_enough_points(spark):
    df = spark.createDataFrame([(1, float(x), 2.0 * x) for x in range(12)] + [(2, 1.0, 1.0)], "k int, x double, y double")
    assert [r.k for r in S.trends(df, "k", "x", "y", with_p=False).collect()] == [1]
    with pytest.raises(Exception, match="2 has 1 points"):
        S.trends(df, "k", "x", "y", with_p=False, strict=True).collect()
