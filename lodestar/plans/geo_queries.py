"""Spatial queries: suppliers as points, customers as boxes with a rank and a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import spatial as G

from .registry import query
from .tables import table

POINTS = "points AS (SELECT s_suppkey AS id, CAST(s_nationkey % 3 AS INTEGER) AS pref, 35.0 + (s_suppkey * 7919 % 1000) / 20000.0 AS lat, 137.0 + (s_suppkey * 104729 % 1000) / 20000.0 AS lon FROM supplier)"
BOXES = """boxes AS (SELECT c_custkey AS box_id, CAST(c_nationkey % 3 AS INTEGER) AS pref, CAST(c_custkey % 7 AS INTEGER) AS rank, CAST(2012 + c_custkey % 5 AS INTEGER) AS version,
  137.0 + (c_custkey * 6151 % 1000) / 20000.0 AS x0, 35.0 + (c_custkey * 3571 % 1000) / 20000.0 AS y0,
  137.0 + (c_custkey * 6151 % 1000) / 20000.0 + 0.0002 + (c_custkey % 11) / 20000.0 AS x1, 35.0 + (c_custkey * 3571 % 1000) / 20000.0 + 0.0002 + (c_custkey % 13) / 20000.0 AS y1 FROM customer)"""
PAIRS = """pairs AS (SELECT * FROM (SELECT p.id, p.pref, p.lat, p.lon, box_id, rank, version, x0, y0, x1, y1,
  sqrt(greatest((x0 - lon) * cos(radians(lat)) * 111320, 0, (lon - x1) * cos(radians(lat)) * 111320) ** 2 + greatest((y0 - lat) * 110574, 0, (lat - y1) * 110574) ** 2) AS distance
  FROM points p JOIN boxes b ON p.pref = b.pref) WHERE distance <= {r})"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), (F.col("s_nationkey") % 3).cast("int").alias("pref"), (F.lit(35.0) + (k * 7919 % 1000) / 20000.0).alias("lat"), (F.lit(137.0) + (k * 104729 % 1000) / 20000.0).alias("lon"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = F.lit(137.0) + (k * 6151 % 1000) / 20000.0, F.lit(35.0) + (k * 3571 % 1000) / 20000.0
    return table(spark, sf, "customer").select(k.alias("box_id"), (F.col("c_nationkey") % 3).cast("int").alias("pref"), (k % 7).cast("int").alias("rank"), (2012 + k % 5).cast("int").alias("version"), x.alias("x0"), y.alias("y0"), (x + 0.0002 + (k % 11) / 20000.0).alias("x1"), (y + 0.0002 + (k % 13) / 20000.0).alias("y1"))


def pairs(spark: SparkSession, sf: str, metres: float) -> DataFrame:
    return G.near_pairs(points(spark, sf), boxes(spark, sf), metres, 0.01, ["pref"])


def clipped_once(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Boxes within 500 m clipped to the disc around each place, and the points of each place."""
    once, members = G.places(points(spark, sf), ["pref"])
    return G.clipped(G.near_pairs(once, boxes(spark, sf), 500.0, 0.01, ["pref"]), 500.0), members


@query("radius_join", f"WITH {POINTS}, {BOXES}, {PAIRS.format(r=500)} SELECT id, box_id, round(distance, 3) AS distance FROM pairs")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf, 500.0).select("id", "box_id", F.round("distance", 3).alias("distance"))


RADII = f"""WITH {POINTS}, {BOXES}, {PAIRS.format(r=500)}, r AS (SELECT id, CAST(radius AS DOUBLE) AS radius FROM points, (VALUES (100), (200), (500)) v(radius)),
best AS (SELECT r.id, r.radius, rank, version, row_number() OVER (PARTITION BY r.id, r.radius ORDER BY rank DESC NULLS LAST, version DESC) AS i FROM r LEFT JOIN pairs p ON r.id = p.id AND distance <= radius)"""


def _within(spark: SparkSession, sf: str) -> DataFrame:
    return G.max_within(pairs(spark, sf, 500.0), points(spark, sf), "id", [100.0, 200.0, 500.0], "rank", "version")


@query("max_rank_within", f"{RADII} SELECT id, radius, rank, version FROM best WHERE i = 1")
def max_rank_within(spark: SparkSession, sf: str) -> DataFrame:
    return _within(spark, sf)


@query("radius_transitions", f"{RADII}, l AS (SELECT radius, coalesce(rank, -1) AS r, lag(coalesce(rank, -1)) OVER (PARTITION BY id ORDER BY radius) AS b FROM best WHERE i = 1) SELECT radius, CAST(count(*) FILTER (r <> b) AS BIGINT) AS changed, CAST(count(*) FILTER (r < b) AS BIGINT) AS violations FROM l WHERE b IS NOT NULL GROUP BY 1")
def radius_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return G.transitions(_within(spark, sf), "id", "rank")


@query("newest_version", f"WITH {POINTS}, {BOXES}, {PAIRS.format(r=800)}, n AS (SELECT *, max(version) OVER (PARTITION BY id, rank) AS newest FROM pairs) SELECT id, rank, version, count(*) AS n FROM n WHERE version = newest GROUP BY 1, 2, 3")
def newest_version(spark: SparkSession, sf: str) -> DataFrame:
    once, members = G.places(points(spark, sf), ["pref"])
    # Boxes of one version stay or go together, so they are counted where they are.
    counts = G.near_pairs(once, boxes(spark, sf), 800.0, 0.01, ["pref"]).groupBy("id", "rank", "version").agg(F.count("*").alias("n"))
    return G.of_points(G.newest_only(counts, "id", "version", ["rank"]), members)


@query("rank_distribution", f"{RADII} SELECT radius, coalesce(CAST(rank AS VARCHAR), 'none') AS rank, count(*) AS n FROM best WHERE i = 1 GROUP BY 1, 2")
def rank_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _within(spark, sf).groupBy("radius", F.coalesce(F.col("rank").cast("string"), F.lit("none")).alias("rank")).agg(F.count("*").alias("n"))


@query("local_plane", f"WITH {POINTS} SELECT id, round((lon - 137.02) * cos(radians(35.02)) * 111320, 4) AS x, round((lat - 35.02) * 110574, 4) AS y FROM points")
def local_plane(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("id", F.round(C.local_x(F.col("lon"), F.lit(137.02), F.lit(35.02)), 4).alias("x"), F.round(C.local_y(F.col("lat"), F.lit(35.02)), 4).alias("y"))


@query("clipped_areas")
def clipped_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes clipped to the 128-sided disc of 500 m: SQL has no polygons; tested against closed forms."""
    rings, members = clipped_once(spark, sf)
    return G.of_points(rings.groupBy("id", "rank", "version").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area")), members)


@query("dissolved_areas")
def dissolved_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the clipped boxes by point, rank and version; tested on overlapping rectangles."""
    rings, members = clipped_once(spark, sf)
    d = G.of_points(G.dissolved_areas(rings.select("id", "rank", "version", "ring"), ["id", "rank", "version"]), members)
    return d.select("id", "rank", "version", "n", F.round("union_area", 3).alias("union_area"), F.round("sum_area", 3).alias("sum_area"))


@query("search_circles", f"WITH {POINTS} SELECT id, CAST(65 AS BIGINT) AS n, round(lon - 500 / (cos(radians(lat)) * 111320), 6) AS x0, round(lat - 500 / 110574.0, 6) AS y0, round(lon + 500 / (cos(radians(lat)) * 111320), 6) AS x1, round(lat + 500 / 110574.0, 6) AS y1 FROM points")
def search_circles(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of 65 points; their outermost ones lie due north, east, south and west."""
    p = points(spark, sf).select("id", G.circle_ring("lon", "lat", F.lit(500.0)).alias("ring"))
    x, y = F.transform("ring", lambda q: q[0]), F.transform("ring", lambda q: q[1])
    return p.select("id", F.size("ring").cast("long").alias("n"), F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


@query("geojson_features", f"WITH {POINTS}, p AS (SELECT id, CASE WHEN id % 5 <> 0 THEN round(lat, 6) END AS y, CASE WHEN id % 7 <> 0 THEN round(lon, 6) END AS x FROM points) SELECT row_number() OVER (ORDER BY id) - 1 AS feature, id, x, y FROM p WHERE x IS NOT NULL AND y IS NOT NULL")
def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.operators.publish import features

    p = points(spark, sf).select("id", F.when(F.col("id") % 5 != 0, F.round("lat", 6)).alias("y"), F.when(F.col("id") % 7 != 0, F.round("lon", 6)).alias("x"))
    return features(p, "id", "x", "y").select("feature", "id", "x", "y")


@query("simplification_steps")
def simplification_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What coarser outlines save and cost: vertices, bytes, change of area by tolerance."""
    s = G.simplification_steps(clipped_once(spark, sf)[0], (0.0, 1.0, 3.0, 10.0))
    return s.withColumn("most_change", F.round("most_change", 6)).withColumn("most_apart", F.round("most_apart", 6))


@query("polygon_size_gate", "SELECT 'area changes by 1 % at most' AS gate, true AS passed UNION ALL SELECT 'control: 10 m is too coarse', false")
def polygon_size_gate(spark: SparkSession, sf: str) -> DataFrame:
    """No published outline's area may change by over 1 %; simplifying all by 10 m must fail."""
    from lodestar.operators.checks import Check, report

    rings, _ = clipped_once(spark, sf)
    return report([Check("area changes by 1 % at most", G.published_outlines(rings).filter("most_change > 0.01")), Check("control: 10 m is too coarse", G.simplification_steps(rings, (10.0,)).filter("most_change > 0.01"))])
