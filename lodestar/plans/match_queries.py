"""Queries of entity matching and of labels: suppliers as the master, customers as a gazetteer with doubled codes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import matching as M

from .registry import query
from .tables import table

# The same derived tables on both sides: codes repeat and names repeat, so that cardinality guards decide.
GAZETTEER = """gaz AS (SELECT CASE WHEN c_custkey % 3 <> 1 THEN CAST(c_custkey % 90 AS BIGINT) END AS code, c_nationkey AS area, 'N' || CAST(c_custkey % 37 AS VARCHAR) AS name, c_custkey AS gid,
  CAST(20 + (c_custkey * 7919 % 2600) / 100.0 AS DOUBLE) AS lat, CAST(122 + (c_custkey * 104729 % 3200) / 100.0 AS DOUBLE) AS lon FROM customer)"""
MASTER = "master AS (SELECT s_suppkey AS id, s_suppkey AS code, s_nationkey AS area, 'N' || CAST(s_suppkey % 37 AS VARCHAR) AS name FROM supplier)"
STAGES = """one AS (SELECT code, area, name, count(*) AS n, any_value(gid) AS gid, any_value(lat) AS lat, any_value(lon) AS lon FROM gaz GROUP BY 1, 2, 3 HAVING count(*) = 1),
two AS (SELECT code, area, any_value(gid) AS gid, any_value(lat) AS lat, any_value(lon) AS lon FROM gaz GROUP BY 1, 2 HAVING count(*) = 1),
three AS (SELECT area, name, any_value(gid) AS gid, any_value(lat) AS lat, any_value(lon) AS lon FROM gaz GROUP BY 1, 2 HAVING count(*) = 1),
matched AS (SELECT m.id, m.code, m.area, m.name, coalesce(CASE WHEN a.gid IS NOT NULL THEN 'code_name_area' END, CASE WHEN b.gid IS NOT NULL THEN 'code_area' END, CASE WHEN c.gid IS NOT NULL THEN 'name_area' END) AS method,
  coalesce(a.gid, b.gid, c.gid) AS gid, coalesce(a.lat, b.lat, c.lat) AS lat, coalesce(a.lon, b.lon, c.lon) AS lon
  FROM master m LEFT JOIN one a ON m.code = a.code AND m.area = a.area AND m.name = a.name LEFT JOIN two b ON m.code = b.code AND m.area = b.area LEFT JOIN three c ON m.area = c.area AND m.name = c.name)"""


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.when(k % 3 != 1, k % 90).alias("code"), F.col("c_nationkey").alias("area"), F.concat(F.lit("N"), k % 37).alias("name"), k.alias("gid"),
        (F.lit(20.0) + (k * 7919 % 2600) / 100.0).alias("lat"), (F.lit(122.0) + (k * 104729 % 3200) / 100.0).alias("lon"),
    )


def master(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(s.alias("id"), s.alias("code"), F.col("s_nationkey").alias("area"), F.concat(F.lit("N"), s % 37).alias("name"))


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return M.cascade(master(spark, sf), gazetteer(spark, sf), "id", "code", "area", "name", ["gid", "lat", "lon"])


@query("staged_match", f"WITH {GAZETTEER}, {MASTER}, {STAGES} SELECT id, code, area, name, method, gid, lat, lon FROM matched")
def staged_match(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf).select("id", "code", "area", "name", "method", "gid", "lat", "lon")


@query("match_methods", f"WITH {GAZETTEER}, {MASTER}, {STAGES} SELECT coalesce(method, 'none') AS method, count(*) AS n FROM matched GROUP BY 1")
def match_methods(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf).groupBy(F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"))


CENTROIDS = "cent AS (SELECT code, avg(lat) AS lat, avg(lon) AS lon FROM gaz GROUP BY 1), box AS (SELECT area, min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1 FROM matched WHERE lat IS NOT NULL GROUP BY 1)"


@query("centroid_fallback", f"""WITH {GAZETTEER}, {MASTER}, {STAGES}, {CENTROIDS}, j AS (SELECT m.*, c.lat AS c_lat, c.lon AS c_lon, coalesce(c.lat BETWEEN lat0 - 2.5 AND lat1 + 2.5 AND c.lon BETWEEN lon0 - 2.5 AND lon1 + 2.5, false) AS ok FROM matched m LEFT JOIN cent c ON m.code = c.code LEFT JOIN box b ON m.area = b.area)
SELECT id, round(CASE WHEN lat IS NULL AND ok THEN c_lat ELSE lat END, 6) AS lat, round(CASE WHEN lat IS NULL AND ok THEN c_lon ELSE lon END, 6) AS lon, CASE WHEN lat IS NULL AND ok THEN 'centroid' ELSE method END AS method, lat IS NULL AND c_lat IS NOT NULL AND NOT ok AS rejected FROM j""")
def centroid_fallback(spark: SparkSession, sf: str) -> DataFrame:
    cents = M.vertex_means(gazetteer(spark, sf).select("code", "lat", "lon"), "code", "lon", "lat")
    f = M.fallback(matched(spark, sf), cents, "code", "area", 2.5)
    return f.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "method", "rejected")


@query("area_boxes", f"WITH {GAZETTEER}, {MASTER}, {STAGES}, {CENTROIDS} SELECT * FROM box")
def area_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return M.bounding_boxes(matched(spark, sf).filter("lat is not null"), "area", "lat", "lon")


@query("majority_vote", f"WITH {GAZETTEER}, v AS (SELECT name, area, count(*) AS votes FROM gaz GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY votes DESC, area) AS i, CAST(sum(votes) OVER (PARTITION BY name) AS BIGINT) AS total FROM v) SELECT name, area, votes, total FROM r WHERE i = 1")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return M.majority(gazetteer(spark, sf), "name", "area").select("name", "area", "votes", "total")


@query("coordinate_coverage", f"WITH {GAZETTEER}, {MASTER}, {STAGES} SELECT round(count(lat) / count(*), 6) AS coverage, CAST(count(*) FILTER (lat IS NOT NULL AND NOT (lat BETWEEN 20 AND 46 AND lon BETWEEN 122 AND 154)) AS BIGINT) AS outside, count(lat) >= 0.5 * count(*) AS passed FROM matched")
def coordinate_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf).agg(F.round(F.count("lat") / F.count("*"), 6).alias("coverage"), F.count_if(F.col("lat").isNotNull() & ~C.in_range(F.col("lat"), F.col("lon"))).alias("outside"), (F.count("lat") >= 0.5 * F.count("*")).alias("passed"))


@query("attribute_join", f"WITH {GAZETTEER}, {MASTER}, {STAGES} SELECT id, m.method, CAST(g.gid % 7 AS BIGINT) AS outer_m, CAST(g.gid % 5 AS BIGINT) AS mooring_m FROM matched m JOIN gaz g ON m.gid = g.gid WHERE g.gid % 7 > 0 AND g.gid % 5 > 0")
def attribute_join(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of the row that the match chose: its id is carried, so the choice is not made twice; a length of 0 is missing."""
    g = gazetteer(spark, sf).select("gid", (F.col("gid") % 7).alias("outer_m"), (F.col("gid") % 5).alias("mooring_m"))
    return matched(spark, sf).join(g, "gid").filter("outer_m > 0 and mooring_m > 0").select("id", "method", "outer_m", "mooring_m")


@query("set_differences", "WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier), b AS (SELECT DISTINCT CASE WHEN c_nationkey % 5 = 3 THEN c_nationkey + 100 ELSE c_nationkey END AS k FROM customer) SELECT k, 'missing' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'unexpected' FROM b WHERE k NOT IN (SELECT k FROM a)")
def set_differences(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    b = table(spark, sf, "customer").select(F.when(F.col("c_nationkey") % 5 == 3, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("k")).distinct()
    return M.differences(a, b)


@query("append_parts", "SELECT 'supplier' AS part, count(*) AS n, count(DISTINCT s_nationkey) AS areas FROM supplier UNION ALL SELECT 'customer', count(*), count(DISTINCT c_nationkey) FROM customer")
def append_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.lit("supplier").alias("part"), F.col("s_nationkey").alias("area")).unionByName(table(spark, sf, "customer").select(F.lit("customer").alias("part"), F.col("c_nationkey").alias("area")))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("area").alias("areas"))


@query("uniqueness_checks", "SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(*) = count(DISTINCT o_orderkey) AS passed FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem")
def uniqueness_checks(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, df, *k: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct(*k).alias("keys")).withColumn("passed", F.col("n") == F.col("keys"))
    return one("orders", table(spark, sf, "orders"), "o_orderkey").unionByName(one("lineitem", table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber"))


@query("token_candidates", "WITH t AS (SELECT split_part(p_name, ' ', 2) AS token, min(p_type) AS kind FROM part GROUP BY 1), h AS (SELECT DISTINCT p_partkey AS id, kind FROM part JOIN t ON contains(p_name, token)) SELECT id, min(kind) AS kind FROM h GROUP BY 1 HAVING count(*) = 1")
def token_candidates(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    tokens = part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("token")).agg(F.min("p_type").alias("kind"))
    return M.single_candidate(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), tokens, "id", "text", "token", "kind")


#: The endings in order, one at a time, again and again until none is taken off.
PLACE_TOKENS = r"""WITH RECURSIVE e AS (SELECT ['s', 'ing', 'er', 'ed', 'th'] AS e), t AS (SELECT item_id, string_split_regex(text, '[ ,]') AS ts FROM benchmark), p AS (SELECT item_id, unnest(range(len(ts))) AS pos, unnest(ts) AS t FROM t),
s AS (SELECT item_id, pos, t, 1 AS i, false AS moved FROM p UNION ALL
 SELECT item_id, pos, CASE WHEN hit THEN left(t, length(t) - length(w)) ELSE t END, CASE WHEN i = 5 THEN CASE WHEN moved OR hit THEN 1 ELSE 6 END ELSE i + 1 END, CASE WHEN i = 5 THEN false ELSE moved OR hit END
 FROM (SELECT s.*, e.e[i] AS w, ends_with(t, e.e[i]) AS hit FROM s, e WHERE i <= 5)),
d AS (SELECT * FROM s WHERE i = 6 AND length(t) >= 2)
SELECT b.item_id, count(d.t) AS n_tokens, coalesce(string_agg(d.t, '|' ORDER BY pos), '') AS tokens FROM benchmark b LEFT JOIN d ON b.item_id = d.item_id GROUP BY 1"""


@query("place_tokens", PLACE_TOKENS)
def place_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All tokens of each text, their endings taken off to a fixed point."""
    strip = M.place_tokens(["s", "ing", "er", "ed", "th"], r"[ ,]")
    docs = table(spark, sf, "benchmark")
    return docs.select("item_id", strip(F.col("text")).alias("tokens")).select("item_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


NAMED = """a AS (SELECT n_nationkey AS area_no, n_name || '沿岸' || (CASE WHEN n_nationkey % 2 = 0 THEN '西部' ELSE '' END) AS area_name, n_name AS token FROM nation WHERE length(n_name) >= 2),
p AS (SELECT c_custkey AS id, CASE CAST(c_custkey % 5 AS INTEGER) WHEN 0 THEN n_name || '市' WHEN 1 THEN '旧' || n_name || '・NATION_' || CAST((c_nationkey + 11) % 25 AS VARCHAR) || '町' WHEN 2 THEN '' WHEN 3 THEN c_mktsegment ELSE NULL END AS muni,
  CASE WHEN c_custkey % 7 = 0 THEN '不明' ELSE left(n_name, 8 - CAST(c_custkey % 2 AS INTEGER)) END AS stem FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT id, count(DISTINCT area_no) AS n, min(area_no) AS area_no FROM p JOIN a ON contains(muni, token) GROUP BY 1), c AS (SELECT id, count(DISTINCT area_no) AS n, min(area_no) AS area_no FROM p JOIN a ON contains(area_name, stem) GROUP BY 1)
SELECT p.id, CASE WHEN coalesce(f.n, c.n) = 1 THEN coalesce(f.area_no, c.area_no) END AS area_no, CASE WHEN coalesce(f.n, c.n, 0) = 0 THEN 'none' WHEN f.n = 1 THEN 'municipality_named' WHEN f.n > 1 THEN 'ambiguous_municipality_named' WHEN c.n = 1 THEN 'prefecture_named' ELSE 'ambiguous_prefecture_named' END AS method, CAST(coalesce(f.n, c.n, 0) AS BIGINT) AS n
FROM p LEFT JOIN f ON f.id = p.id LEFT JOIN c ON c.id = p.id"""


@query("named_areas", f"WITH {NAMED}")
def named_areas(spark: SparkSession, sf: str) -> DataFrame:
    """The sea area that a place's municipality names, else its prefecture; none and ambiguous ones with their reason."""
    nation = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    areas = nation.select(k.alias("area_no"), F.concat("n_name", F.lit("沿岸"), F.when(k % 2 == 0, "西部").otherwise("")).alias("area_name")).withColumn("tokens", M.place_tokens(["西部", "沿岸"])(F.col("area_name")))
    c = F.col("c_custkey")
    muni = F.when(c % 5 == 0, F.concat("n_name", F.lit("市"))).when(c % 5 == 1, F.concat(F.lit("旧"), "n_name", F.lit("・NATION_"), ((F.col("c_nationkey") + 11) % 25).cast("string"), F.lit("町"))).when(c % 5 == 2, "").when(c % 5 == 3, F.col("c_mktsegment"))
    places = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == k).select(c.alias("id"), muni.alias("muni"), F.when(c % 7 == 0, "不明").otherwise(F.left("n_name", (8 - c % 2).cast("int"))).alias("stem"))
    return M.named_areas(places, "id", "muni", "stem", areas, "area_no", "area_name", "tokens")


# Labels ---------------------------------------------------------------------------------------------------------------

#: Spellings of one interval, by the remainder of the part's key.
_SPELL = ("{a}～{b}m", "{a}m以上 ～ {b}m未満", "{a}m～", "～{b}m", "{a}m以上", "{b}m未満", "{a}.0m以上～{b}.0m未満", " {a}〜{b}m")
RAW = "raw AS (SELECT p_partkey AS id, CASE CAST(p_partkey % 8 AS INTEGER) " + " ".join(f"WHEN {i} THEN " + " || ".join({"{a}": "CAST(p_size AS VARCHAR)", "{b}": "CAST(p_size + 1 + p_partkey % 3 AS VARCHAR)"}.get(x, f"'{x}'") for x in re.split(r"(\{a\}|\{b\})", t) if x) for i, t in enumerate(_SPELL)) + " END AS label FROM part)"
PARSED = r"""form AS (SELECT id, label, translate(regexp_replace(label, '\s+', '', 'g'), '〜～', '~~') AS t FROM raw),
bounds AS (SELECT id, label, CASE WHEN regexp_matches(t, '^[\d.]+m以上~?[\d.]+m未満$') OR regexp_matches(t, '^[\d.]+m以上$') OR regexp_matches(t, '^[\d.]+~[\d.]+m$') OR regexp_matches(t, '^[\d.]+m~$') THEN CAST(regexp_extract(t, '^([\d.]+)', 1) AS DOUBLE) ELSE 0.0 END AS low,
 CASE WHEN regexp_matches(t, '以上$') OR regexp_matches(t, 'm~$') THEN CAST('Infinity' AS DOUBLE) ELSE CAST(regexp_extract(t, '([\d.]+)m(未満)?$', 1) AS DOUBLE) END AS high FROM form),
named AS (SELECT *, CASE WHEN low = 0 THEN '〜' || regexp_replace(CAST(high AS VARCHAR), '\.0$', '') || 'm' WHEN isinf(high) THEN regexp_replace(CAST(low AS VARCHAR), '\.0$', '') || 'm〜' ELSE regexp_replace(CAST(low AS VARCHAR), '\.0$', '') || '〜' || regexp_replace(CAST(high AS VARCHAR), '\.0$', '') || 'm' END AS canonical FROM bounds)"""


def raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("p_size").cast("string"), (F.col("p_size") + 1 + F.col("p_partkey") % 3).cast("string")
    label = F.lit(None).cast("string")
    for i, t in enumerate(_SPELL):
        label = F.when(F.col("p_partkey") % 8 == i, F.replace(F.replace(F.lit(t), F.lit("{a}"), a), F.lit("{b}"), b)).otherwise(label)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), label.alias("label"))


def parsed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct labels are parsed once and joined back."""
    raw = raw_labels(spark, sf)
    known = raw.select("label").distinct().withColumn("b", C.label_bounds(F.col("label"))).select("label", "b.low", "b.high")
    return raw.join(known, "label").withColumn("canonical", C.canonical_label(F.col("low"), F.col("high")))


@query("parsed_labels", f"WITH {RAW}, {PARSED} SELECT id, label, low, coalesce(nullif(high, CAST('Infinity' AS DOUBLE)), -1.0) AS high, canonical FROM named")
def parsed_labels_query(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_labels(spark, sf).select("id", "label", "low", F.when(F.col("high") == C.INF, F.lit(-1.0)).otherwise(F.col("high")).alias("high"), "canonical")


@query("label_order", f"WITH {RAW}, {PARSED}, u AS (SELECT DISTINCT canonical, low, high FROM named) SELECT canonical, dense_rank() OVER (ORDER BY low, high) AS rank FROM u")
def label_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    u = parsed_labels(spark, sf).select("canonical", "low", "high").distinct()
    return u.select("canonical", F.dense_rank().over(Window.orderBy("low", "high")).cast("long").alias("rank"))


@query("nested_labels", f"WITH {RAW}, {PARSED}, u AS (SELECT DISTINCT canonical, low, high FROM named) SELECT o.canonical AS outer_label, i.canonical AS inner_label FROM u o JOIN u i ON o.low < i.low AND i.high < o.high")
def nested_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Strictly nested pairs of the label vocabulary: a self-join over distinct labels, whose number the sizes bound at every scale. It has a second name from when the first read a prefix of the parts."""
    return nested_pairs(parsed_labels(spark, sf))


def nested_pairs(labels: DataFrame) -> DataFrame:
    u = labels.select("canonical", "low", "high").distinct()
    o, i = u.select(F.col("canonical").alias("outer_label"), F.col("low").alias("ol"), F.col("high").alias("oh")), u.select(F.col("canonical").alias("inner_label"), "low", "high")
    return o.join(i, (F.col("ol") < F.col("low")) & (F.col("high") < F.col("oh"))).select("outer_label", "inner_label")


@query("label_overlaps", f"WITH {RAW}, {PARSED}, f AS (SELECT DISTINCT id % 20 AS file, low, high, canonical FROM named), w AS (SELECT *, lag(high) OVER p AS before, lag(canonical) OVER p AS prev FROM f WINDOW p AS (PARTITION BY file ORDER BY low, high)) SELECT file, prev, canonical FROM w WHERE low < before")
def label_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("low", "high")
    f = parsed_labels(spark, sf).select((F.col("id") % 20).alias("file"), "low", "high", "canonical").distinct()
    return f.withColumn("before", F.lag("high").over(w)).withColumn("prev", F.lag("canonical").over(w)).filter("low < before").select("file", "prev", "canonical")


@query("label_vocabularies", f"WITH {RAW}, {PARSED}, v AS (SELECT id % 20 AS file, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS words FROM named GROUP BY 1) SELECT md5(words) AS vocabulary, count(*) AS files, min(file) AS first FROM v GROUP BY 1")
def label_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    v = parsed_labels(spark, sf).groupBy((F.col("id") % 20).alias("file")).agg(F.array_join(F.array_sort(F.collect_set("canonical")), "|").alias("words"))
    return v.groupBy(F.md5("words").alias("vocabulary")).agg(F.count("*").alias("files"), F.min("file").alias("first"))


@query("depth_bins", f"WITH {RAW}, {PARSED} SELECT CAST((low >= 0.3)::INT + (low >= 1)::INT + (low >= 3)::INT + (low >= 10)::INT AS INTEGER) AS bin, count(*) AS n FROM named GROUP BY 1")
def depth_bins(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_labels(spark, sf).groupBy(C.depth_bin(F.col("low")).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("rejected_labels", "SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1")
def rejected_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Text that is no label, set aside instead of raising."""
    t = table(spark, sf, "part").withColumn("b", C.label_bounds(F.col("p_type"), strict=False)).filter("b is null")
    return t.groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("n"))
