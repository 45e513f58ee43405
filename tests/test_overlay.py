"""Overlay, simplification that keeps topology, published outlines and nearest polygons: closed forms, identities of areas, mutants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import overlay as O
from lodestar.operators import spatial as G


def star(rng, n, cx, cy, r):
    return np.array([[cx + rng.uniform(0.3, 1) * r * math.cos(t), cy + rng.uniform(0.3, 1) * r * math.sin(t)] for t in sorted(rng.random() * 2 * math.pi for _ in range(n))])


def polygon(rng):
    cx, cy = rng.uniform(0, 100), rng.uniform(0, 100)
    p = [star(rng, rng.randrange(3, 12), cx, cy, 40)]
    if rng.random() < 0.5:
        p.append(star(rng, rng.randrange(3, 6), cx, cy, 10))
    if rng.random() < 0.3:  # crosses itself
        p.append(np.array([[rng.uniform(0, 100), rng.uniform(0, 100)] for _ in range(5)]))
    return p


def test_areas_are_inclusion_and_exclusion():
    rng = random.Random(3)
    for k in range(1000):
        a, b = ([polygon(rng) for _ in range(rng.randrange(1, 4))] for _ in range(2))
        if k % 5 < 2:  # a coarse grid: edges on edges, corners on edges
            a, b = ([[np.round(r / 10) * 10 for r in p] for p in x] for x in (a, b))
        whole_a, whole_b, both, either, rest, other, apart = (O.region_area(O.overlay(*x)) for x in ((a, [], "union"), (b, [], "union"), (a, b, "intersection"), (a, b, "union"), (a, b, "difference"), (b, a, "difference"), (a, b, "apart")))
        assert either == pytest.approx(whole_a + whole_b - both, abs=1e-3)
        assert (rest, other, apart) == pytest.approx((whole_a - both, whole_b - both, rest + other), abs=1e-3)


def test_holes_and_touching_parts():
    frame = [*O.square(0, 0, 10, 10), *O.square(2, 2, 4, 4), *O.square(6, 6, 8, 8)]
    (p,) = O.overlay([frame], [], "union")
    assert len(p) == 3 and O.region_area([p]) == 92 and [O.ring_area(r) < 0 for r in p] == [False, True, True]
    # A corner: two polygons. An edge: one.
    assert len(O.overlay([O.square(0, 0, 1, 1), O.square(1, 1, 2, 2)], [], "union")) == 2
    (one,) = O.overlay([O.square(0, 0, 1, 1), O.square(1, 0, 2, 1)], [], "union")
    assert O.region_area([one]) == 2 and not any((r == [1, 0.5]).all(axis=1).any() for r in one)
    bow = [np.array([[0, 0], [2, 2], [2, 0], [0, 2.0]])]
    assert O.region_area(O.overlay([bow], [], "union")) == pytest.approx(2)
    island = O.overlay([frame], [O.square(2, 2, 4, 4)], "union")
    assert O.region_area(island) == 96
    assert O.overlay([], [O.square(0, 0, 1, 1)], "intersection") == [] == O.overlay([O.square(0, 0, 1, 1)], [O.square(0, 0, 1, 1)], "difference")
    assert O.overlay([[np.zeros((0, 2))], [np.array([[1, 1], [1, 1.0]])]], [], "union") == []


def test_result_overlaid_with_itself_is_itself():
    rng = random.Random(9)
    for _ in range(100):
        r = O.overlay([polygon(rng) for _ in range(3)], [polygon(rng)], "difference")
        assert O.region_area(O.overlay(r, r, "intersection")) == pytest.approx(O.region_area(r), abs=1e-3)
        assert O.region_area(O.overlay(r, r, "apart")) == pytest.approx(0, abs=1e-3)


def test_simplification_keeps_rings_apart_and_holes_inside():
    # A bulge of 0.9 that holds a hole: a step of 1 would leave the hole outside.
    bulge = np.array([[0, 0], [10, 0], [10.5, -0.9], [11, 0], [40, 0], [40, 30.0], [20, 30.2], [0, 30.0]])
    thin = [bulge, np.array([[10.4, -0.3], [10.5, -0.6], [10.6, -0.3]])[::-1], *O.square(20, 20, 22, 22)]
    free = [G.simplify(r, 1.0) for r in thin]
    assert O._clashes(free, 1e6)
    for t in (0.2, 1.0, 5.0):
        some = O.thinned(thin, t)
        assert not O._clashes(some, 1e6) and len(some) == 3
        (p,) = O.overlay([some], [], "union")
        assert len(p) == 3
    region, step, change = O.published([thin], (5.0, 1.0, 0.5, 0.0), 0.01)
    assert change <= 0.01
    jagged = O.overlay([[star(random.Random(1), 60, 0, 0, 100)]], [], "union")
    _, step, change = O.published(jagged, (40.0, 1.0, 0.5, 0.0))
    assert step < 40 and change <= 0.01 and O.published(jagged, (40.0,))[2] > 0.01


def test_tiles_add_up(spark):
    rng = random.Random(4)
    rows = [(k % 2, k, k % 3, [r.tolist() for r in polygon(rng)]) for k in range(40)]
    df = spark.createDataFrame(rows, "g long, k long, version int, rings array<array<array<double>>>")
    got = {r.g: (r.area, r.perimeter) for r in O.dissolved(df, ["g"], 16.0).groupBy("g").agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter")).collect()}
    for g in (0, 1):
        whole = O.overlay(O.as_region(r[3] for r in rows if r[0] == g), [], "union")
        length = sum(float(np.hypot(*(np.roll(r, -1, axis=0) - r).T).sum()) for p in whole for r in p)
        assert got[g] == pytest.approx((O.region_area(whole), length), rel=1e-4)
    left = {r.k: r.area for r in O.newest_first(df, ["g"], "k", "version", 16.0).groupBy("k").agg(F.sum("area").alias("area")).collect()}
    for g, k, version, rings in rows:
        newer = O.as_region(r[3] for r in rows if r[0] == g and r[2] > version)
        assert left.get(k, 0.0) == pytest.approx(O.region_area(O.overlay(O.as_region([rings]), newer, "difference")), abs=1e-2)
    assert O.dissolved(df.limit(0), ["g"], 16.0).count() == 0
    odd = spark.createDataFrame([(1, None), (1, []), (1, [[[0.0, 0.0], [1.0, 1.0]]])], "g long, rings array<array<array<double>>>")
    assert O.dissolved(odd, ["g"], 16.0).count() == 0


def test_outlines_reproduce_the_table_and_controls_fail(spark):
    from lodestar.plans.overlay_queries import outline_gates

    gates = {r.gate: r.passed for r in outline_gates(spark, "/root/testdata/sf0.01").collect()}
    assert gates == {"outlines reproduce the table": True, "area changes by 1 % at most": True, "files have 300 KB at most": True, "control: outlines moved by 60 m": False}
    ring = [[300 * math.cos(a / 500 * math.pi) * (1 + 0.2 * (a % 2)), 300 * math.sin(a / 500 * math.pi) * (1 + 0.2 * (a % 2))] for a in range(1000)]
    many = spark.createDataFrame([(1, 35.0, 137.0, 1, 2020, [ring])] + [(1, 35.0, 137.0, r, 2021, [ring]) for r in range(20)], "id long, lat double, lon double, rank int, version int, rings array<array<array<double>>>")
    (row,) = G.published_files(many, [500.0]).collect()
    assert row.bytes > 300_000 and (row.rank, row.version, row.features) == (19, 2021, 21)
    assert G.edge_distance([O.square(3, 4, 5, 5)]) == 5 and G.edge_distance([O.square(-1, -1, 1, 1)]) == 0 and G.edge_distance([]) == math.inf
    assert G.edge_distance([[*O.square(-9, -9, 9, 9), *O.square(-2, -3, 3, 3)]]) == 2


def test_nearest_polygon_however_far(spark):
    ring = lambda x, y: [[[x, y], [x + 0.001, y], [x + 0.001, y + 0.001], [x, y + 0.001], [x, y]]]
    polygons = spark.createDataFrame([(k, x, y, x + 0.001, y + 0.001, ring(x, y), "a") for k, x, y in ((1, 137.0, 35.0), (2, 138.0, 35.0), (3, 137.0, 35.0), (4, 150.0, 40.0))], "box_id long, x0 double, y0 double, x1 double, y1 double, rings array<array<array<double>>>, area string")
    points = spark.createDataFrame([(1, 35.0005, 137.0005, "a"), (2, 35.0, 137.4, "a"), (3, 30.0, 149.0, "a"), (4, 35.0, 137.9, "b")], "id long, lat double, lon double, area string")
    got = {r.id: (r.box_id, round(r.distance)) for r in G.nearest_polygons(points, polygons, 50.0, 0.001, ["area"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 4} and got[1][1] == 0 and got[3][1] > 1_000_000
