"""What shows only on larger tables: keys that meet by chance, ties in the last bits."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import overlay as O
from lodestar.operators import similar as N
from lodestar.operators import spatial as G
from lodestar.operators import trainers as T
from lodestar.operators.stages import kept
from lodestar.plans import geo_queries, source_queries
from lodestar.plans.registry import ORACLE_SQL
from lodestar.sources import text

from .oracle import differences


def test_a_line_of_another_files_area_is_no_second_line(spark, tmp_path):
    (tmp_path / "area7.txt").write_text("yyyy,mm,dd,areaNo.,flag,Temp.\n2024,1,1,8,R,10.5\n2024,1,2,7,R,3\n2024,1,2,7,R,3\n")
    (tmp_path / "area8.txt").write_text("yyyy,mm,dd,areaNo.,flag,Temp.\n2024,1,1,8,R,11.5\n")
    good, bad = text.daily_files(spark, str(tmp_path))
    assert [(r.area, str(r.d), r.temp) for r in good.collect()] == [("8", "2024-01-01", 11.5)]
    assert sorted((r.file_area, r.reason) for r in bad.collect()) == [("7", "area"), ("7", "duplicate"), ("7", "duplicate")]


@pytest.mark.parametrize("name", ["daily_scan", "daily_quarantine"])
def test_every_areas_faults_are_found(spark, tmp_path, name):
    """Customers of areas 70 to 79: each file's wrong lines name an area that isn't its own."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("o_custkey", 17500 + F.col("o_custkey") * 17 % 2500)
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert c.sql("SELECT count(*) FROM orders WHERE o_custkey // 250 = 77 AND o_orderkey % 50 = 2").fetchall()[0][0] > 0
    assert differences(getattr(source_queries, name)(spark, str(tmp_path)), ORACLE_SQL[name], c) == []


def test_nearest_polygons_within_a_micrometre_tie(spark):
    ring = lambda x0, x1: [[[x0, 35.0], [x1, 35.0], [x1, 35.001], [x0, 35.001]]]
    metre = 1 / (111320 * math.cos(math.radians(35.0005)))
    rows = [(k, x, 35.0, x + 0.001, 35.001, ring(x, x + 0.001), a) for k, x, a in ((1, 137.001, "a"), (2, math.nextafter(137.001, 137), "a"), (3, 137 + 50.0000003 * metre, "b"), (4, 137 + 49.9999998 * metre, "b"))]
    polygons = spark.createDataFrame(rows, "box_id long, x0 double, y0 double, x1 double, y1 double, rings array<array<array<double>>>, area string")
    points = spark.createDataFrame([(1, 35.0005, 137.0, "a"), (2, 35.0005, 137.0, "b")], "id long, lat double, lon double, area string")
    assert {r.id: r.box_id for r in G.nearest_polygons(points, polygons, 50.0, 0.001, ["area"]).collect()} == {1: 1, 2: 3}


def _boxes(rng, n, reach, size):
    low = rng.integers(-reach, reach, (n, 2)) * 1.0
    high = low + rng.integers(1, size, (n, 2))
    return np.stack([low, np.stack([high[:, 0], low[:, 1]], axis=1), high, np.stack([low[:, 0], high[:, 1]], axis=1)], axis=1)


def test_rings_are_clipped_at_once_as_one_by_one():
    window, rings = G.disc(50.0), _boxes(np.random.default_rng(1), 300, 60, 40)
    out, count = G.clip_all(rings, window)
    for ring, got, n, size in zip(rings, out, count, G.areas(out, count), strict=True):
        one = G.clip(ring, window)
        assert len(one) == n and (one == got[:n]).all() and size == pytest.approx(G.area(one), abs=1e-9)


def test_unions_and_shares_by_one_sweep():
    rng = np.random.default_rng(2)
    regions = [[[r] for r in _boxes(rng, n, reach, 9)] for n, reach in ((1, 5), (12, 40), (25, 12), (6, 300))]
    for region, one, area in zip(regions, O.united(regions), O.union_areas(regions), strict=True):
        cells = {(x, y) for (r,) in region for x in range(int(r[0][0]), int(r[2][0])) for y in range(int(r[0][1]), int(r[2][1]))}
        assert area == len(cells) == pytest.approx(O.region_area(one)) == pytest.approx(O.overlay_area(region, [], "union"))
    # A lone polygon that isn't convex, or whose ring crosses itself, is swept.
    bow = [np.array([[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 4.0]])]
    star = [np.array([[math.cos(a * 4 * math.pi / 5), math.sin(a * 4 * math.pi / 5)] for a in range(5)])]
    assert O.union_areas([[bow], [O.square(9, 9, 10, 10)[::-1]]]) == [8.0, 1.0] and O.union_areas([[star]])[0] < O.ring_area(star[0])
    generation = rng.integers(0, 4, 25).tolist()
    for k, (area, n) in enumerate(O.shares_of_first(regions[2], generation)):
        left = O.overlay([regions[2][k]], [p for p, g in zip(regions[2], generation, strict=True) if g < generation[k]], "difference")
        assert area == pytest.approx(O.region_area(left)) and n == len(left)


def test_few_bytes_of_pairs_are_dealt_to_all_cores(spark):
    pairs = geo_queries.pairs(spark, "/root/testdata/sf0.001", 500.0)
    tasks = G.clipped(pairs, 500.0).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_points_of_one_place(spark):
    points = spark.createDataFrame([(5, 35.0, 137.0, 1), (3, 35.0, 137.0, 1), (4, 35.0, 137.0, 2)], "id long, lat double, lon double, pref int")
    once, members = G.places(points, ["pref"])
    assert sorted((r.id, r.pref, r.copies) for r in once.collect()) == [(3, 1, 2), (4, 2, 1)]
    assert sorted(tuple(r) for r in G.of_points(spark.createDataFrame([(3, "x")], "id long, v string"), members).collect()) == [(3, "x"), (5, "x")]


def test_rows_are_sent_once_to_many_rings(spark):
    """Vectors without structure meet all rings, here 63: each row is sent to a few shelves of them, and its vector doesn't stand beside each neighbour."""
    x = np.random.default_rng(3).standard_normal((2000, 6))
    df = kept(spark.createDataFrame([(i, v.tolist(), [i]) for i, v in enumerate(x)], "key long, vec array<double>, ids array<long>"))
    seen = {}
    best = N.best_of(df, 4, 1e-9, 32, seen.__setitem__)
    got = {}
    for r in best.collect():
        got.setdefault(r.key, []).append((r.far, r.dst))
    d = N.distances(x, x)
    assert all([dst for _, dst in sorted(got[i])] == d[i].argsort(kind="stable")[:4].tolist() for i in range(2000))
    assert 2000 <= seen["copies"] <= 9 * 2000 and seen["pairs"] > 0.3 * 2000**2 and "vec" not in best.columns


@pytest.mark.parametrize("name", ["polygon_join", "radius_join"])
def test_pairs_are_found_by_all_cores(spark, name):
    """Few bytes of boxes meet in many pairs: not in one task."""
    df = {"polygon_join": source_queries.polygon_join, "radius_join": geo_queries.radius_join}[name](spark, "/root/testdata/sf0.01")
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_newest_version_sends_counts(spark):
    """What is shuffled for the newest version is counts, not pairs: the window stands above an aggregation."""
    plan = geo_queries.newest_version(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Window") :].split("Join")[0]


def test_a_perceptron_reads_some_rows_at_a_time(monkeypatch):
    rng, seen, sums = np.random.default_rng(4), [], T.Net.sums
    x, y = rng.standard_normal((5000, 3)), rng.integers(0, 3, 5000)
    monkeypatch.setattr(T.Net, "sums", lambda net, x, y, w: seen.append(len(x)) or sums(net, x, y, w))
    net, whole = T.perceptron_local(x, y, np.ones(5000), 3, rounds=20), T.Net([3, 32, 16, 3], 5)
    for _ in range(20):
        whole.step(sums(whole, x, y, np.ones(5000)), 1e-3, 0.01)
    assert max(seen) <= 2048 and sum(seen) == 20 * 5000 and np.allclose(net.numbers, whole.numbers, atol=1e-9)
    z = rng.standard_normal((7, 4))
    assert np.allclose(T.softmax(z), np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)) and T.softmax(z[:0]).shape == (0, 4)
