"""Gates, predictions and findings that are judged from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import oplog as O
from lodestar.operators import publish as P
from lodestar.operators import series as S
from lodestar.operators import similar as N

from . import vector_queries
from .registry import query
from .series_queries import COVER, DAILY, DOY, EVENTS, LINES, YEARLY, _clim, _lines, _orders, _yearly, r6
from .tables import folder, table

# Heatwaves ------------------------------------------------------------------------------------------------------------


@query("normal_gate", f"WITH {DAILY}, {_clim(5, 0.9)}, n AS (SELECT key, CAST({DOY} AS BIGINT) AS doy, avg(value) AS normal FROM daily WHERE year(d) BETWEEN 1995 AND 1999 GROUP BY ALL), e AS (SELECT abs(mean - normal) / normal AS e FROM clim JOIN n USING (key, doy)) SELECT round(median(e), 6) AS median, round(max(e), 6) AS most, median(e) <= 0.25 AND max(e) <= 4 AS passed FROM e")
def normal_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The windowed climatology against normals of single days: how far it is off usually and at most."""
    days = _orders(spark, sf)
    single = days.filter(F.year("d").between(1995, 1999)).groupBy("key", C.day_of_cycle(F.col("d")).cast("long").alias("doy")).agg(F.avg("value").alias("normal"))
    return S.normal_gate(S.climatology(days, 1995, 1999), single, 0.25, 4.0).select(r6("median", "median"), r6("most", "most"), "passed")


@query("exceedance_control", f"WITH {DAILY}, {_clim(5, 0.5)}, r AS (SELECT a.key, avg(CAST(value > threshold AS DOUBLE)) AS rate FROM daily a JOIN clim c ON a.key = c.key AND CAST({DOY} AS BIGINT) = doy WHERE year(d) BETWEEN 1995 AND 1999 GROUP BY 1) SELECT round(median(rate), 6) AS median_rate, NOT median(rate) BETWEEN 0.05 AND 0.15 AS noticed FROM r")
def exceedance_control(spark: SparkSession, sf: str) -> DataFrame:
    """The control of the exceedance gate: medians in place of the 90th percentile must fall out of its bounds."""
    days = _orders(spark, sf)
    rate = S.exceedance(S.with_climatology(days.filter(F.year("d").between(1995, 1999)), S.climatology(days, 1995, 1999, q=0.5)))
    return rate.agg(r6(F.median("rate"), "median_rate"), (~F.median("rate").between(0.05, 0.15)).alias("noticed"))


@query(
    "heat_expectations",
    f"""WITH {LINES}, {EVENTS.format(min_days=2, gap=1)}, {COVER}, s AS (SELECT key, count(*) AS n FROM cover WHERE d BETWEEN DATE '1998-06-01' AND DATE '1998-08-31' GROUP BY 1), g AS (SELECT * FROM (VALUES ('E6', 'A'), ('E6', 'N'), ('E7', 'N'), ('E7', 'R'), ('E7', 'X')) v(name, key)),
m AS (SELECT name, count(*) FILTER (coalesce(n, 0) >= 30) AS observed FROM g LEFT JOIN s USING (key) GROUP BY 1),
p AS (SELECT a.key, avg(CASE WHEN a.d < DATE '1999-01-01' THEN CASE WHEN c.d IS NULL THEN 0.0 ELSE 1.0 END END) AS before, avg(CASE WHEN a.d >= DATE '1999-01-01' THEN CASE WHEN c.d IS NULL THEN 0.0 ELSE 1.0 END END) AS after FROM days a LEFT JOIN cover c ON a.key = c.key AND a.d = c.d GROUP BY 1)
SELECT name, CAST(observed AS BIGINT) AS observed, observed >= 2 AS held FROM m UNION ALL SELECT 'E8', CAST(count(*) FILTER (after > before) AS BIGINT), count(*) FILTER (after > before) * 2 > count(*) FROM p""",
)
def heat_expectations(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions about summers and shares, judged by formulas fixed beforehand."""
    days = _lines(spark, sf)
    groups = {"E6": ("A", "N"), "E7": ("N", "R", "X")}
    return S.heat_expectations(days, S.events(days, 2, 1), groups, ("1998-06-01", "1998-08-31"), 30, 2, F.col("d") >= F.lit("1999-01-01").cast("date"), "E8")


# Neighbours -----------------------------------------------------------------------------------------------------------


@query("nearest_quantiles", f"WITH {vector_queries.V}, {vector_queries.KNN.format(a='a.vec', b='b.vec', k=1)} SELECT round(quantile_cont(distance, 0.05), 6) AS low, round(quantile_cont(distance, 0.5), 6) AS middle, round(quantile_cont(distance, 0.95), 6) AS high FROM knn")
def nearest_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """How far the nearest rows are: 5, 50 and 95 percent of them."""
    near = N.nearest(vector_queries._vectors(spark, sf), 1)
    return near.agg(*[r6(F.percentile("distance", F.lit(q)), n) for q, n in ((0.05, "low"), (0.5, "middle"), (0.95, "high"))])


@query("flag_mismatches", f"WITH {vector_queries.V}, {vector_queries.KNN.format(a='a.vec', b='b.vec', k=1)} SELECT CAST(count(*) FILTER (len(list_filter(range(1, 9), lambda i: (a.vec[i] > 0) <> (b.vec[i] > 0))) > 0) AS BIGINT) AS any_differs, count(*) AS n FROM knn JOIN v a ON src = a.id JOIN v b ON dst = b.id")
def flag_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Of how many rows the nearest one differs in any of eight flags."""
    v = vector_queries._vectors(spark, sf).select("id", F.transform(F.slice("vec", 1, 8), lambda x: x > 0).alias("flags"))
    pairs = N.nearest(vector_queries._vectors(spark, sf), 1).join(v.select(F.col("id").alias("src"), F.col("flags").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("flags").alias("b")), "dst")
    return pairs.agg(F.count_if(F.col("a") != F.col("b")).alias("any_differs"), F.count("*").alias("n"))


@query("overlap_gate", f"WITH {vector_queries.V}, {vector_queries.FULL}, {vector_queries.HEAD}, s AS (SELECT k.src, count(h.dst) / 10 AS share FROM knn k LEFT JOIN head h ON k.src = h.src AND k.dst = h.dst GROUP BY 1) SELECT round(avg(share), 6) AS overlap, avg(share) < 0.5 AS notice FROM s")
def overlap_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether neighbours hang on the choice of columns: a mean overlap under a half must be told to readers."""
    v = vector_queries._vectors(spark, sf)
    shares = N.overlap(N.nearest(v, 10), N.nearest(v, 10, columns=slice(0, 4)), 10)
    return shares.agg(r6(F.avg("share"), "overlap"), (F.avg("share") < 0.5).alias("notice"))


@query("search_agreement", f"WITH {vector_queries.V}, {vector_queries.FULL}, m AS (SELECT distance, list_distance(a.vec, b.vec) AS again, lead(distance) OVER (PARTITION BY src ORDER BY rank) AS nxt FROM knn JOIN v a ON src = a.id JOIN v b ON dst = b.id) SELECT count(*) AS n, CAST(count(*) FILTER (abs(distance - again) > 1e-9) AS BIGINT) AS off, CAST(count(*) FILTER (nxt < distance - 1e-9) AS BIGINT) AS disordered FROM m")
def search_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """The distances of the search against a second implementation."""
    v = vector_queries._vectors(spark, sf)
    return N.audited(N.nearest(v, 10), v.select("id", "vec"))


@query(
    "trend_agreement",
    f"""WITH {YEARLY}, a AS (SELECT key, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM yearly GROUP BY 1 HAVING count(*) >= 4),
    b AS (SELECT key, covar_pop(y, x) / var_pop(x) AS slope, avg(y) - covar_pop(y, x) / var_pop(x) * avg(x) AS intercept FROM yearly GROUP BY 1 HAVING count(*) >= 4),
    c AS (SELECT abs(a.slope - b.slope) <= 1e-9 * greatest(1, abs(a.slope)) AND abs(a.intercept - b.intercept) <= 1e-9 * greatest(1, abs(a.intercept)) AS ok FROM a JOIN b USING (key))
    SELECT count(*) AS n, CAST(count(*) FILTER (ok) AS BIGINT) AS agree, count(*) = count(*) FILTER (ok) AS passed FROM c""",
)
def trend_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Trends from the builtin regression against those from moments: slopes, intercepts and errors."""
    y = _yearly(spark, sf).drop("n")
    return S.agreeing(S.trends(y, "key", "x", "y", min_points=4, with_p=False), S.trends_by_moments(y, "key", "x", "y", 4), "key", ["slope", "intercept", "se"])


# Texts and changes ----------------------------------------------------------------------------------------------------


@query(
    "hygiene_lines",
    r"""WITH t AS (SELECT doc_id, text || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'Ж ж' WHEN 1 THEN 'keep 한' WHEN 2 THEN 'ㄱ' || chr(1) ELSE '' END AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) + 1 AS i FROM t), k AS (SELECT doc_id, i, concat_ws(',', CASE WHEN regexp_matches(line, '[\x{0400}-\x{052F}]') THEN 'cyrillic' END, CASE WHEN regexp_matches(line, '[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]') THEN 'hangul' END, CASE WHEN regexp_matches(line, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'control' END) AS kinds FROM l WHERE NOT contains(line, 'keep'))
SELECT doc_id, CAST(i AS BIGINT) AS line, kinds FROM k WHERE kinds <> ''""",
)
def hygiene_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with characters that don't belong there, but for marked ones."""
    more = F.when(F.col("doc_id") % 5 == 0, "Ж ж").when(F.col("doc_id") % 5 == 1, "keep 한").when(F.col("doc_id") % 5 == 2, "ㄱ\x01").otherwise("")
    return O.hygiene_lines(table(spark, sf, "documents").withColumn("text", F.concat_ws("\n", "text", more)), "doc_id", "text", "keep")


_DIFF_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS added, unnest(range(len(string_split(text, chr(10))))) + 1 + doc_id % 50 AS line FROM documents)"


@query(
    "added_line_findings",
    rf"""WITH {_DIFF_LINES}, p AS (SELECT * FROM (VALUES ('private key', true, '-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----'), ('access key', true, 'AKIA[0-9A-Z]{{16}}'), ('credential', true, '(?i)\b(api[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*[''"][^''"]{{8,}}[''"]'), ('eval', false, '\beval\s*\('), ('statement', false, '(?i)(execute|cursor\.execute)\s*\(\s*["''].*%s.*["'']\s*%')) v(label, blocks, pattern))
SELECT 'd' || doc_id AS file, CAST(line AS BIGINT) AS line, label, blocks FROM l JOIN p ON regexp_matches(added, pattern) WHERE doc_id % 10 <> 3""",
)
def added_line_findings(spark: SparkSession, sf: str) -> DataFrame:
    """What diffs must not or should not add, by file and line; a tenth of the files is exempt."""
    lines = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("+"), x)), "\n")
    head = F.concat(F.lit("--- a/x\n+++ b/d"), "doc_id", F.lit("\n@@ -0,0 +"), 1 + F.col("doc_id") % 50, F.lit(" @@\n"))
    diffs = table(spark, sf, "documents").select("doc_id", F.concat(head, lines).alias("diff"))
    return O.findings(O.added_lines(diffs, "doc_id", "diff"), "added", "3$").select("file", "line", "label", "blocks")


@query("largest_changes", "SELECT 'o' || l_orderkey AS path, CAST(sum(l_quantity) + count(*) AS DOUBLE) AS lines FROM lineitem WHERE NOT regexp_matches('o' || l_orderkey, '^o9') GROUP BY l_orderkey ORDER BY 2 DESC, 1 LIMIT 5")
def largest_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The five files that change most, without exempt ones."""
    rows = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("o"), "l_orderkey").alias("path")).agg(F.sum("l_quantity").cast("double").alias("added"), F.count("*").alias("deleted"))
    return O.largest(rows, "path", "added", "deleted", "^o9")


@query("forced_strings", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'sha' ELSE 'n' END AS key, CAST(event_id AS VARCHAR) || 'e' || (user_id % 10) AS value, event_id % 2 = 1 AS is_json FROM events")
def forced_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Values that look like numbers stay texts where their key says so; text without a sign would raise."""
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "sha=").otherwise("n="), F.col("event_id").cast("string"), F.lit("e"), F.col("user_id") % 10)
    return table(spark, sf, "events").select("event_id", O.key_value(text, ("sha",), strict=True).alias("p")).select("event_id", "p.*")


_OUTPUT = "text || CASE doc_id % 7 WHEN 0 THEN chr(10) || (doc_id % 13) || ' passed in 1s' WHEN 1 THEN chr(10) || 'sh: Command Not Found' WHEN 2 THEN ' no tests ran' ELSE '' END"


@query(
    "run_outcomes",
    rf"""WITH o AS (SELECT doc_id, lower({_OUTPUT}) AS t, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 127 ELSE 1 END AS code, CASE WHEN doc_id % 3 = 0 THEN 'make check' ELSE 'python -m pytest' END AS command FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, CASE WHEN regexp_matches(t, 'command not found|not recognized as an internal|no such file or directory|cannot find module|this is not the tsc command') THEN 'not started' WHEN regexp_matches(t, 'no tests ran|no tests were found|no test files found|no tests found|missing script|no test specified') THEN 'nothing ran' WHEN code = 5 AND contains(command, 'pytest') THEN 'nothing collected' WHEN code = 127 THEN 'not found'
  WHEN code = 0 AND NOT regexp_matches(t, '\b\d+ (passed|failed|errors?|skipped)\b|\btests?\s+\d+|test result:\s*(ok|failed)|\b\d+\s+(tests?|examples?),\s*\d+\s+(failures?|assertions?)') THEN 'no evidence' ELSE '' END AS reason FROM o)
SELECT doc_id, reason = '' AS ran, reason FROM r""",
)
def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether outputs show that tests ran, with exit codes that alone say too little."""
    d = F.col("doc_id")
    tail = F.when(d % 7 == 0, F.concat(F.lit("\n\x1b[32m"), (d % 13).cast("string"), F.lit(" passed\x1b[0m in 1s"))).when(d % 7 == 1, "\nsh: Command Not Found").when(d % 7 == 2, " no tests ran").otherwise("")
    code = F.when(d % 4 == 0, 0).when(d % 4 == 1, 5).when(d % 4 == 2, 127).otherwise(1)
    command = F.when(d % 3 == 0, "make check").otherwise("python -m pytest")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", O.run_outcome(F.concat("text", tail), code, command).alias("r")).select("doc_id", "r.*")


# Sinks and sources ----------------------------------------------------------------------------------------------------


@query("known_classes", "SELECT c_custkey AS id, array_to_string(list_filter(string_split(c_mktsegment || ',X' || c_nationkey || ',BUILDING', ','), lambda x: x IN ('BUILDING', 'FURNITURE', 'X7')), '|') AS classes FROM customer")
def known_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Of a list in an address only the classes that exist are taken."""
    text = F.concat("c_mktsegment", F.lit(",X"), "c_nationkey", F.lit(",BUILDING"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(C.known_items(text, ("BUILDING", "FURNITURE", "X7")), "|").alias("classes"))


@query("replaced_parts", "SELECT s_nationkey AS part, count(*) AS n, CASE WHEN s_nationkey % 3 = 0 THEN 'second' ELSE 'first' END AS run FROM supplier GROUP BY 1")
def replaced_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that changed take the place of the old ones; the others stay."""
    at, s = folder(spark, "replaced"), table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("part")).agg(F.count("*").alias("n"))
    P.replaced(s.withColumn("run", F.lit("first")), at, "part")
    return P.replaced(s.filter("part % 3 = 0").withColumn("run", F.lit("second")), at, "part", only=True).select("part", "n", "run")


@query("fetch_resume", "SELECT s_suppkey AS id FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0)")
def fetch_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are there with their size aren't fetched again; one of another size is."""
    plan = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (1000 + F.col("s_suppkey")).alias("bytes"))
    there = plan.select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("id"), F.when(F.col("id") % 4 == 0, F.col("bytes") - 1).otherwise(F.col("bytes")).alias("bytes"))
    return P.sizes_checked(P.to_fetch(plan, there, "id", "bytes").withColumn("got", F.col("bytes") * 1.01), "bytes", "got").select("id")
