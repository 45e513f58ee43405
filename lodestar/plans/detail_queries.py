"""Queries of feature tables, gates, diagnostics and small page computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import publish as P
from lodestar.operators import similar as N
from lodestar.operators import spatial as G

from . import geo_queries, match_queries, vector_queries
from .geo_queries import RADII
from .registry import query
from .tables import table


@query("feature_table", """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS class, c_custkey % 13 * 10 AS outer_m, c_custkey % 11 * 5 AS mooring_m, CASE c_custkey % 4 WHEN 0 THEN '○' WHEN 1 THEN '◎' WHEN 2 THEN NULL ELSE '○' END AS mark,
  CASE c_custkey % 5 WHEN 0 THEN '離島' WHEN 1 THEN '半島' WHEN 2 THEN '離島半島' ELSE NULL END AS island, 'S' || CAST(20 + c_custkey % 40 AS VARCHAR) || '.4.1' AS designated, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS VARCHAR) END AS sub FROM customer)
SELECT id, class, round(ln(1 + outer_m), 6) AS log_outer, round(ln(1 + mooring_m), 6) AS log_mooring, CASE WHEN mark = '○' THEN 1 ELSE 0 END AS berth, CASE WHEN mark = '◎' THEN 1 ELSE 0 END AS double_mark, CASE WHEN island IN ('離島', '離島半島') THEN 1 ELSE 0 END AS is_island, CASE WHEN island IN ('半島', '離島半島') THEN 1 ELSE 0 END AS is_peninsula,
  CAST(1925 + CAST(regexp_extract(designated, 'S(\\d+)', 1) AS INTEGER) AS INTEGER) AS year, CAST(coalesce(CAST(sub AS INTEGER), 0) AS INTEGER) AS subdistricts FROM c WHERE outer_m > 0 AND mooring_m > 0""".replace("\\\\", "\\"))
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Features by class: lengths of 0 are missing and drop the row, marks and eras are read strictly."""
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    c = table(spark, sf, "customer").select(
        k.alias("id"), F.col("c_mktsegment").alias("class"), (k % 13 * 10).alias("outer_m"), (k % 11 * 5).alias("mooring_m"), pick(4, "○", "◎", None, "○").alias("mark"), pick(5, "離島", "半島", "離島半島", None, None).alias("island"),
        F.concat(F.lit("S"), 20 + k % 40, F.lit(".4.1")).alias("designated"), F.when(k % 3 != 0, (k % 7).cast("string")).alias("sub"),
    )
    among = lambda *v: C.member(F.col("island"), v, ("離島", "奄美", "半島", "離島半島"))
    c = c.withColumn("outer_m", C.measured(F.col("outer_m"), 3)).withColumn("mooring_m", C.measured(F.col("mooring_m"), 3))
    return c.filter("outer_m is not null and mooring_m is not null").select(
        "id", "class", F.round(F.log1p("outer_m"), 6).alias("log_outer"), F.round(F.log1p("mooring_m"), 6).alias("log_mooring"), C.mark_flag(F.col("mark"), "○").alias("berth"), C.mark_flag(F.col("mark"), "◎").alias("double_mark"),
        among("離島", "離島半島").alias("is_island"), among("半島", "離島半島").alias("is_peninsula"), C.era_year(F.col("designated")).alias("year"), C.digits_or_zero(F.col("sub")).alias("subdistricts"),
    )


@query("resume_missing", "SELECT n_nationkey AS part FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def resume_missing(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("part"))
    return P.missing_parts(table(spark, sf, "nation").select(F.col("n_nationkey").alias("part")), done, "part")


@query("derived_administrator", "SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 AND n_name = CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE '' END THEN 'prefecture' ELSE 'municipality' END AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def derived_administrator(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("s_nationkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(""))
    return rows.select(F.col("s_suppkey").alias("id"), F.when(name.eqNullSafe(F.col("n_name")), "prefecture").otherwise("municipality").alias("kind"))


@query("class_map", "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'special_3' ELSE CAST(p_size % 5 AS VARCHAR) END AS class FROM part")
def class_map(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("p_size") % 5 == 0, "特3").otherwise((F.col("p_size") % 5).cast("string"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.mapped(code, {"1": "1", "2": "2", "3": "3", "特3": "special_3", "4": "4"}).alias("class"))


@query("reconciliation", "WITH a AS (SELECT o_orderstatus AS k, count(*) AS found FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS k, count(*) AS official FROM orders WHERE o_orderkey % 1000 <> 7 OR o_orderstatus <> 'F' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, found, official FROM a FULL JOIN b ON a.k = b.k WHERE found IS DISTINCT FROM official")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that two sources don't agree on; the second source lacks a few rows, as a control."""
    from lodestar.operators.checks import reconciled

    orders = table(spark, sf, "orders").withColumn("k", F.col("o_orderstatus"))
    n = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    return reconciled(n(orders), n(orders.filter("o_orderkey % 1000 <> 7 or o_orderstatus <> 'F'")), ["k"], "n")


@query("monotone_gate", f"{RADII}, l AS (SELECT id, coalesce(rank, -1) AS r, lag(coalesce(rank, -1)) OVER (PARTITION BY id ORDER BY radius) AS b FROM best WHERE i = 1) SELECT 'radii are monotone' AS gate, count(*) FILTER (r < b) = 0 AS passed FROM l")
def monotone_gate(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.operators.checks import Check, report

    return report([Check("radii are monotone", G.transitions(geo_queries._within(spark, sf), "id", "rank").filter("violations > 0"))])


@query("policy_gate", "SELECT 'no values without a right to them' AS gate, true AS passed UNION ALL SELECT 'special names agree', (SELECT count(DISTINCT n_name) FROM nation) = 25")
def policy_gate(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.operators.checks import Check, report

    from .publish_queries import policy_status

    names = table(spark, sf, "nation").select("n_name").distinct()
    wanted = spark.range(25).select(F.concat(F.lit("NATION_"), "id").alias("n_name"))
    return report([
        Check("no values without a right to them", policy_status(spark, sf).filter("status <> 'observed' and value is not null")),
        Check("special names agree", names.exceptAll(wanted).unionByName(wanted.exceptAll(names))),
    ])


@query("nearest_column_shares", f"WITH {vector_queries.V}, {vector_queries.KNN.format(a='a.vec', b='b.vec', k=1)}, d AS (SELECT src, CAST(i.i AS INTEGER) AS dim, (a.vec[i.i + 1] - b.vec[i.i + 1]) ** 2 AS sq, distance FROM knn JOIN v a ON src = a.id JOIN v b ON dst = b.id, range(64) i(i)) SELECT dim, round(avg(sq / (distance * distance)), 6) AS share, CAST(count(*) AS BIGINT) AS n FROM d WHERE distance > 0 GROUP BY 1")
def nearest_column_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns make up the squared distance to the nearest row."""
    v = vector_queries._vectors(spark, sf)
    a, b = v.select(F.col("id").alias("src"), F.col("vec").alias("x")), v.select(F.col("id").alias("dst"), F.col("vec").alias("y"))
    pairs = N.nearest(v, 1).filter("distance > 0").join(a, "src").join(b, "dst")
    sq = pairs.select("distance", F.posexplode(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q))).alias("dim", "sq"))
    return sq.groupBy("dim").agg(F.round(F.avg(F.col("sq") / (F.col("distance") * F.col("distance"))), 6).alias("share"), F.count("*").alias("n"))


FLAG_PAIR = """WITH p AS (SELECT label, embedding[1] > 0 AS a, embedding[2] > 0 AS b, embedding[3] > 0 AS c FROM embeddings),
l AS (SELECT 0 AS i, 'f_d1' AS first, 'f_d2' AS second, label, a || '|' || b AS part FROM p UNION ALL SELECT 1, 'f_d1', 'f_d3', label, a || '|' || c FROM p UNION ALL SELECT 2, 'f_d2', 'f_d3', label, b || '|' || c FROM p),
ij AS (SELECT i, sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM (SELECT i, label, part, count(*) AS n FROM l GROUP BY 1, 2, 3) GROUP BY 1), x AS (SELECT i, sum(n * (n - 1) / 2) AS x FROM (SELECT i, label, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1), y AS (SELECT i, sum(n * (n - 1) / 2) AS y FROM (SELECT i, part, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT i, (ij - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)) AS ari FROM ij JOIN x USING (i) JOIN y USING (i))
SELECT DISTINCT first, second, round(ari, 6) AS ari FROM l JOIN r USING (i) WHERE i = (SELECT i FROM r ORDER BY ari DESC, i LIMIT 1)"""


@query("best_flag_pair", FLAG_PAIR)
def best_flag_pair(spark: SparkSession, sf: str) -> DataFrame:
    """The two flags whose partition is nearest to the labels by adjusted Rand index."""
    p = vector_queries._dims(spark, sf).select("label", *[(F.col(d) > 0).alias(f"f_{d}") for d in ("d1", "d2", "d3")])
    return N.best_flag_pair(p, "label", ["f_d1", "f_d2", "f_d3"]).withColumn("ari", F.round("ari", 6))


@query("points_in_boxes", f"WITH {geo_queries.POINTS}, {geo_queries.BOXES} SELECT p.id, count(box_id) AS inside FROM points p LEFT JOIN boxes b ON p.pref = b.pref AND lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1")
def points_in_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A diagnostic: how many boxes hold each point; the points meet boxes by grid cells."""
    p = geo_queries.points(spark, sf)
    n = geo_queries.pairs(spark, sf, 1.0).filter("distance = 0").groupBy("id").agg(F.count("*").alias("inside"))
    return p.select("id").join(n, "id", "left").withColumn("inside", F.coalesce("inside", F.lit(0)).cast("long"))


@query("newer_clips_older")
def newer_clips_older(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each clipped box after newer versions: polygon differences, tested on rectangles."""
    rings, members = geo_queries.clipped_once(spark, sf)
    parts = rings.select("id", F.col("box_id").alias("object_id"), "version", F.concat(F.lit("v"), "version").alias("file"), "ring")
    return G.of_points(G.newer_first(parts, "id"), members).withColumn("area", F.round("area", 3))


@query("vote_counts", f"WITH {vector_queries.PRED}, n AS (SELECT id, pred, count(*) AS n, min(repeat) AS f FROM pred GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS i FROM n) SELECT CAST(round(n / 5 * 5) AS BIGINT) AS votes, count(*) AS rows FROM r WHERE i = 1 GROUP BY 1")
def vote_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vector_queries.majority_prediction(spark, sf).groupBy(F.round(F.col("share") * 5).cast("long").alias("votes")).agg(F.count("*").alias("rows"))


@query("back_transformed_medians", "SELECT p_type AS class, CAST(round(exp(median(ln(1 + p_retailprice))) - 1) AS BIGINT) AS median FROM part GROUP BY 1")
def back_transformed_medians(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("class")).agg(F.round(F.expm1(F.median(F.log1p("p_retailprice")))).cast("long").alias("median"))


@query("frequent_flags", "WITH s AS (SELECT p_type AS class, avg((p_size > 20)::INT) AS large, avg((p_retailprice > 950)::INT) AS dear, avg((p_name LIKE 'red%')::INT) AS red FROM part GROUP BY 1) SELECT class, concat_ws(',', CASE WHEN large >= 0.5 THEN 'large' END, CASE WHEN dear >= 0.5 THEN 'dear' END, CASE WHEN red >= 0.5 THEN 'red' END) AS flags FROM s")
def frequent_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = {"large": F.col("p_size") > 20, "dear": F.col("p_retailprice") > 950, "red": F.col("p_name").startswith("red")}
    s = table(spark, sf, "part").groupBy(F.col("p_type").alias("class")).agg(*[F.avg(c.cast("int")).alias(k) for k, c in flags.items()])
    return s.select("class", F.concat_ws(",", *[F.when(F.col(k) >= 0.5, k) for k in flags]).alias("flags"))


@query("without_coordinates", f"WITH {match_queries.GAZETTEER}, {match_queries.MASTER}, {match_queries.STAGES} SELECT area, count(*) AS n, CAST(count(*) FILTER (lat IS NULL) AS BIGINT) AS without FROM matched GROUP BY 1")
def without_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return match_queries.matched(spark, sf).groupBy("area").agg(F.count("*").alias("n"), F.count_if(F.col("lat").isNull()).alias("without"))


@query("neighbour_sections", f"WITH {vector_queries.V}, {vector_queries.KNN.format(a='a.vec', b='b.vec', k=3)} SELECT src, string_agg(CAST(dst AS VARCHAR) || ':' || CAST(label AS VARCHAR), ',' ORDER BY rank) AS neighbours FROM knn JOIN v ON dst = id GROUP BY 1")
def neighbour_sections(spark: SparkSession, sf: str) -> DataFrame:
    v = vector_queries._vectors(spark, sf)
    s = P.neighbour_section(N.nearest(v, 3), v.select(F.col("id").alias("dst"), "label"))
    return s.select("src", F.array_join(F.transform("neighbours", lambda n: F.concat_ws(":", n["dst"], n["label"])), ",").alias("neighbours"))


SIMILAR = f"""WITH {vector_queries.V}, {vector_queries.KNN.format(a='a.vec', b='b.vec', k=3)}, s AS (SELECT src, count(*) AS n FROM knn WHERE src % 4 <> 0 GROUP BY 1), b AS (SELECT unnest(['none', 'failed', 'passed']) AS build)
SELECT build, id, CASE build WHEN 'none' THEN 'missing_source' WHEN 'failed' THEN 'suppressed' ELSE CASE WHEN n IS NULL THEN 'not_available' ELSE 'estimated' END END AS status, CAST(CASE WHEN build = 'passed' THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS n FROM v CROSS JOIN b LEFT JOIN s ON src = id"""


@query("similar_sections", SIMILAR)
def similar_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The section of similar rows when there is no report, when its gate fails and when it passes; every fourth row has no neighbours of its own."""
    v = vector_queries._vectors(spark, sf)
    pairs, dims = N.nearest(v, 3).filter("src % 4 <> 0"), v.select(F.col("id").alias("dst"), "label")
    one = lambda build, gate: P.neighbour_states(v.select("id"), "id", pairs, dims, gate).select(F.lit(build).alias("build"), "id", "status", F.coalesce(F.size("neighbours"), F.lit(0)).cast("long").alias("n"))
    return one("none", None).unionByName(one("failed", False)).unionByName(one("passed", True))


@query("versions_descending", f"WITH {geo_queries.BOXES}, u AS (SELECT DISTINCT pref, version FROM boxes) SELECT pref, version, row_number() OVER (PARTITION BY pref ORDER BY version DESC) AS place FROM u")
def versions_descending(spark: SparkSession, sf: str) -> DataFrame:
    u = geo_queries.boxes(spark, sf).select("pref", "version").distinct()
    return u.select("pref", "version", F.row_number().over(Window.partitionBy("pref").orderBy(F.desc("version"))).cast("long").alias("place"))


@query("secret_names", "SELECT doc_id, regexp_matches(text, '(?i)password|secret|api_?key|token') AS named, CAST(len(regexp_extract_all(text, 'token')) AS BIGINT) AS tokens FROM documents")
def secret_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.rlike("text", F.lit("(?i)password|secret|api_?key|token")).alias("named"), F.regexp_count("text", F.lit("token")).cast("long").alias("tokens"))


@query("set_overlap", "SELECT (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier INTERSECT SELECT DISTINCT c_nationkey + CASE WHEN c_nationkey % 4 = 1 THEN 50 ELSE 0 END FROM customer)) AS shared, (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS missing")
def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s, c = table(spark, sf, "supplier").select("s_nationkey"), table(spark, sf, "customer")
    shared = s.intersect(c.select(F.col("c_nationkey") + F.when(F.col("c_nationkey") % 4 == 1, 50).otherwise(0))).agg(F.count("*").alias("shared"))
    return shared.crossJoin(s.subtract(c.select("c_nationkey")).agg(F.count("*").alias("missing")))


@query("best_model_in_order", f"{vector_queries.F1}, m AS (SELECT repeat AS model, round(f1, 2) AS f FROM f) SELECT model, f FROM m ORDER BY f DESC, model LIMIT 1")
def best_model_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The best by score, ties to the one listed first."""
    from lodestar.operators import metrics as X

    f = X.macro_f1(vector_queries.predictions(spark, sf), "repeat", "truth", "pred", [0, 1, 2, 3, 4]).select(F.col("repeat").alias("model"), F.round("f1", 2).alias("f"))
    return f.agg(F.max(F.struct("f", (-F.col("model")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("model"), "b.f")
