"""Queries of publication, search, logs, page layout and page scans."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import layout as L
from lodestar.operators import matching as M
from lodestar.operators import oplog as O
from lodestar.operators import publish as P

from .registry import query
from .tables import table


@query("counter", "SELECT coalesce(CAST(CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS VARCHAR), 'none') AS key, count(*) AS n FROM customer GROUP BY 1")
def counter(spark: SparkSession, sf: str) -> DataFrame:
    return P.counter(table(spark, sf, "customer"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))


@query("zero_filled_counts", "SELECT n_nationkey AS key, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey END = n_nationkey GROUP BY 1")
def zero_filled_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey")).alias("key"))
    return P.zero_filled(rows, "key", table(spark, sf, "nation").select(F.col("n_nationkey").alias("key")))


@query("filtered_parts", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size <> 7 AND contains(replace(lower(p_name || ' ' || p_brand), ' ', ''), 'boltbrand#1')")
def filtered_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Search across the border of two fields; names are written in full-width letters and the words searched for half so, which the Unicode step makes alike."""
    wide = F.translate("p_name", string.ascii_letters, "".join(chr(ord(c) + 0xFEE0) for c in string.ascii_letters))
    key = C.search_key(wide, F.col("p_brand"))
    found = P.filtered(table(spark, sf, "part"), key, "ｂｏｌｔ　BRAND＃1", ("ECONOMY", "SMALL"), "p_type", F.col("p_size") != 7)
    return found.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("first_in_order", "SELECT p_partkey AS id, p_size FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 300")
def first_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter("p_size > 25").select(F.col("p_partkey").alias("id"), "p_size").orderBy("id").limit(300)


@query("normalized_texts", r"SELECT item_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS digest FROM (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS t FROM benchmark)")
def normalized_texts(spark: SparkSession, sf: str) -> DataFrame:
    """NFKC needs Python; these texts are ASCII, which it leaves alone, and fixed values test the rest."""
    return table(spark, sf, "benchmark").select("item_id", C.normalized_text(F.col("text")).alias("t")).select("item_id", F.char_length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("minimal_rows", "SELECT c_custkey AS i, c_name AS n, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS m FROM customer")
def minimal_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").withColumn("segment", F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")))
    return P.minimal(df, {"i": "c_custkey", "n": "c_name", "m": "segment"}, ("segment",))


@query("marked_values", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS BIGINT) END AS value, CASE WHEN c_custkey % 5 = 0 THEN 'not_available' ELSE 'observed' END AS status FROM customer")
def marked_values(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 3)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.valued(v).alias("m")).select("id", "m.value", "m.status")


@query("policy_status", """SELECT s_suppkey AS id, CASE s_nationkey % 4 WHEN 0 THEN CASE WHEN s_acctbal > 0 THEN 'observed' ELSE 'not_available' END WHEN 1 THEN 'suppressed' WHEN 2 THEN 'missing_source' ELSE 'not_applicable' END AS status, CASE WHEN s_nationkey % 4 = 0 AND s_acctbal > 0 THEN s_acctbal END AS value FROM supplier""")
def policy_status(spark: SparkSession, sf: str) -> DataFrame:
    """Only sources that may be redistributed carry values."""
    policy = F.element_at(F.array(*[F.lit(p) for p in ("redistribute", "link_only", "not_provided", "no_data")]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    status = P.policy_status(policy, F.col("s_acctbal") > 0)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), status.alias("status"), F.when(status == "observed", F.col("s_acctbal")).alias("value"))


@query("estimated_sections", "SELECT d.doc_id, quality AS value, CASE WHEN quality IS NULL THEN 'not_available' ELSE 'estimated' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def estimated_sections(spark: SparkSession, sf: str) -> DataFrame:
    s = P.estimated_section(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "quality")
    return s.select("doc_id", "section.value", "section.status")


@query("pruned_policies", "WITH o AS (SELECT * FROM (VALUES (1, 'redistribute'), (2, 'link_only'), (3, 'closed'), (4, 'not_provided'), (5, 'no_data')) o(i, policy)), n AS (SELECT CASE s_nationkey % 4 WHEN 0 THEN 'redistribute' WHEN 1 THEN 'link_only' WHEN 2 THEN 'not_provided' ELSE 'no_data' END AS policy, count(*) AS n FROM supplier GROUP BY 1) SELECT row_number() OVER (ORDER BY i) AS place, policy, n FROM o JOIN n USING (policy)")
def pruned_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Policies in their fixed order; one that no source has is left out."""
    policy = F.element_at(F.array(*[F.lit(p) for p in ("redistribute", "link_only", "not_provided", "no_data")]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    return P.in_fixed_order(table(spark, sf, "supplier").select(policy.alias("policy")), "policy", ["redistribute", "link_only", "closed", "not_provided", "no_data"])


@query("global_rollup", "SELECT count(*) AS n, CAST(count(*) FILTER (s_acctbal > 0) AS BIGINT) AS positive, round(count(*) FILTER (s_acctbal > 0) / count(*) * 100, 1) AS percent, round(median(s_acctbal), 2) AS median FROM supplier")
def global_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("positive"), F.round(F.count_if(F.col("s_acctbal") > 0) / F.count("*") * 100, 1).alias("percent"), F.round(F.median("s_acctbal"), 2).alias("median"))


@query("concentration", "WITH g AS (SELECT c_nationkey AS area, count(*) AS n, count(*) FILTER (c_acctbal < 0) / count(*) AS rate FROM customer GROUP BY 1 HAVING count(*) >= 20) SELECT area, n, round(rate, 6) AS rate FROM g ORDER BY rate DESC, area LIMIT 5")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("n"), (F.count_if(F.col("c_acctbal") < 0) / F.count("*")).alias("rate")).filter("n >= 20")
    return g.orderBy(F.desc("rate"), "area").limit(5).withColumn("rate", F.round("rate", 6))


@query("value_histogram", "SELECT CAST((p_size >= 1)::INT + (p_size >= 5)::INT + (p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 50)::INT AS INTEGER) AS bin, count(*) AS n, round(avg(CAST(p_retailprice = floor(p_retailprice) AS DOUBLE)), 6) AS integers FROM part GROUP BY 1")
def value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bins = C.depth_bin(F.col("p_size"), (1, 5, 10, 20, 50)).cast("int")
    return table(spark, sf, "part").groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("p_retailprice") == F.floor("p_retailprice")).cast("double")), 6).alias("integers"))


# Scans of pages and texts ---------------------------------------------------------------------------------------------


@query("page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label, unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS pos FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS i FROM l) SELECT page_id, url, label, CAST(pos AS BIGINT) AS pos FROM r WHERE i = 1""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.sources.text import links

    return links(table(spark, sf, "pages"), "page_id", "html")


@query("link_counts", r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def link_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("url_parts", r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@query("text_hygiene", r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x{0400}-\x{052F}]')) AS BIGINT) AS cyrillic, CAST(len(regexp_extract_all(text, '[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]')) AS BIGINT) AS hangul, CAST(len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) AS BIGINT) AS control, CAST(len(regexp_extract_all(text, '\r([^\n]|$)')) AS BIGINT) AS lone_cr FROM documents""")
def text_hygiene(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", O.hygiene(F.col("text")).alias("h")).select("doc_id", "h.*")


@query("text_manifest", "SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def text_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


# Logs -----------------------------------------------------------------------------------------------------------------

LOG = """log AS (SELECT CAST(user_id % 5 AS BIGINT) AS file, event_id AS line, user_id, event_type, value, CASE WHEN event_id % 11 = 0 THEN event_id - 5 * (1 + event_id % 3) END AS supersedes, event_id % 11 = 0 AS fix, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
KEPT = """valid AS (SELECT DISTINCT f.file, f.supersedes AS line FROM log f JOIN log t ON f.file = t.file AND f.supersedes = t.line AND NOT t.fix WHERE f.fix AND f.supersedes < f.line),
kept AS (SELECT l.* FROM log l WHERE NOT fix AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.file = l.file AND v.line = l.line))"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("file"), e.alias("line"), "user_id", "event_type", "value", F.when(e % 11 == 0, e - 5 * (1 + e % 3)).alias("supersedes"), (e % 11 == 0).alias("fix"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


@query("corrected_log", f"WITH {LOG}, {KEPT} SELECT file, line, event_type FROM kept")
def corrected_log(spark: SparkSession, sf: str) -> DataFrame:
    return M.without_voided(log(spark, sf), "file", "line", "supersedes", F.col("fix")).select("file", "line", "event_type")


@query("loop_facts", f"WITH {LOG}, {KEPT} SELECT user_id, min(line) AS first, max(line) AS last, count(*) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, arg_max(value, line) FILTER (event_type = 'click') AS last_value FROM kept GROUP BY 1")
def loop_facts(spark: SparkSession, sf: str) -> DataFrame:
    kept = M.without_voided(log(spark, sf), "file", "line", "supersedes", F.col("fix"))
    return O.facts(kept, ["user_id"], "event_type", "line", {"errors": "error"}, {"last_value": ("click", "value")})


@query("two_strikes", f"WITH {LOG} SELECT k, count(*) AS n, count(*) >= 2 AS struck, bool_or(event_type = 'error') AS has_ref FROM log GROUP BY 1")
def two_strikes(spark: SparkSession, sf: str) -> DataFrame:
    return O.strikes(log(spark, sf), "k", F.col("event_type") == "error")


@query("diff_totals", "SELECT count(*) AS files, CAST(coalesce(sum(l_quantity + l_linenumber), 0) AS DOUBLE) AS lines, sum(l_quantity + l_linenumber) > 500 OR count(*) > 30 AS \"over\" FROM lineitem WHERE NOT regexp_matches(l_returnflag || '/' || l_linestatus, '^A/')")
def diff_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("path", F.concat_ws("/", "l_returnflag", "l_linestatus"))
    return O.diff_totals(rows, "path", "l_quantity", "l_linenumber", "^A/", 500, 30)


@query("log_admission", f"WITH {LOG} SELECT CASE WHEN fix AND supersedes >= line THEN 'later target' WHEN fix AND supersedes < 0 THEN 'no target' WHEN event_type NOT IN ('click', 'view', 'error', 'purchase', 'signup') THEN 'unknown event' ELSE 'ok' END AS verdict, count(*) AS n FROM log GROUP BY 1")
def log_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that may be appended and why others may not."""
    v = F.when(F.col("fix") & (F.col("supersedes") >= F.col("line")), "later target").when(F.col("fix") & (F.col("supersedes") < 0), "no target").when(~F.col("event_type").isin("click", "view", "error", "purchase", "signup"), "unknown event").otherwise("ok")
    return log(spark, sf).groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query("key_values", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def key_values(spark: SparkSession, sf: str) -> DataFrame:
    kv = O.key_value(F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    return table(spark, sf, "events").select("event_id", kv.alias("p")).filter("p.is_json").select("event_id", "p.key", "p.value")


@query("conversation_turns", "SELECT conv_id, count(*) AS turns, max(turn) AS last, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS asked, arg_max(role, turn) AS ends_with FROM conversations GROUP BY 1")
def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last"), F.count_if(F.col("role") == "user").alias("asked"), F.max_by("role", "turn").alias("ends_with"))


# Layout ---------------------------------------------------------------------------------------------------------------

#: All orders, on pages of 50 orders at every scale.
GLYPHS = "glyphs AS (SELECT CAST(l_orderkey // 50 AS BIGINT) AS page, l_extendedprice / 100 AS y, l_quantity * 10 AS x, l_returnflag AS t, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"
LINES = "g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) > 3 OR lag(y) OVER (PARTITION BY page ORDER BY y) IS NULL THEN 1 ELSE 0 END AS s FROM glyphs), lines AS (SELECT *, CAST(sum(s) OVER (PARTITION BY page ORDER BY y) AS BIGINT) AS line FROM g)"


def glyphs(spark: SparkSession, sf: str) -> DataFrame:
    page = F.floor(F.col("l_orderkey") / 50)
    return table(spark, sf, "lineitem").select(page.alias("page"), (F.col("l_extendedprice") / 100).alias("y"), (F.col("l_quantity") * 10).alias("x"), F.col("l_returnflag").alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))


@query("text_lines", f"WITH {GLYPHS}, {LINES} SELECT page, line, round(avg(y) + 1e-6, 4) AS y, count(*) AS n FROM lines GROUP BY 1, 2")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return L.line_means(glyphs(spark, sf), ["page"], "y", 3.0).select("page", "line", F.round(F.col("y") + 1e-6, 4).alias("y"), "n")


@query("row_bands", f"WITH {GLYPHS}, {LINES}, a AS (SELECT page, line, avg(y) AS y FROM lines GROUP BY 1, 2) SELECT page, line, round((y + lag(y) OVER w) / 2 + 1e-6, 4) AS lo, round((y + lead(y) OVER w) / 2 + 1e-6, 4) AS hi FROM a WINDOW w AS (PARTITION BY page ORDER BY y)")
def row_bands(spark: SparkSession, sf: str) -> DataFrame:
    b = L.row_bands(L.line_means(glyphs(spark, sf), ["page"], "y", 3.0), ["page"], "y")
    shown = lambda c: F.when(F.abs(c) == C.INF, F.lit(None).cast("double")).otherwise(F.round(F.col(c) + 1e-6, 4)).alias(c)
    return b.select("page", "line", shown("lo"), shown("hi"))


@query("cell_texts", f"WITH {GLYPHS}, c AS (SELECT page, CAST(floor(x / 100) AS INTEGER) AS col, round(y) AS ry, x, t FROM glyphs) SELECT page, col, string_agg(t, '' ORDER BY ry, x, t) AS cell FROM c GROUP BY 1, 2")
def cell_texts(spark: SparkSession, sf: str) -> DataFrame:
    edges = F.array(*[F.lit(100.0 * i) for i in range(7)])
    g = glyphs(spark, sf).withColumn("col", L.column_of(F.col("x"), edges))
    return L.cell_texts(g, ["page", "col"], "y", "x", "t")


PAGE_CELLS = f"""WITH {GLYPHS}, edges AS (SELECT page, unnest([0.0, 100.0 + 10 * (page % 4), 250.0, 400.0, 510.0]) AS edge FROM (SELECT DISTINCT page FROM glyphs)),
e AS (SELECT page, edge, CAST(row_number() OVER (PARTITION BY page ORDER BY edge) - 1 AS INTEGER) AS col FROM edges), g AS (SELECT glyphs.*, e.col FROM glyphs ASOF JOIN e ON glyphs.page = e.page AND glyphs.x >= e.edge),
m AS (SELECT page, y, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) <= 3.0 THEN 0 ELSE 1 END AS s FROM g WHERE col = 0), l AS (SELECT page, y, sum(s) OVER (PARTITION BY page ORDER BY y) AS line FROM m), a AS (SELECT page, line, avg(y) AS y FROM l GROUP BY 1, 2),
b AS (SELECT page, CAST(line - 1 AS INTEGER) AS row, coalesce((y + lag(y) OVER (PARTITION BY page ORDER BY y)) / 2, CAST('-Infinity' AS DOUBLE)) AS lo FROM a)
SELECT g.page, row, col, string_agg(t, '' ORDER BY round(y), x, t) AS cell FROM g ASOF JOIN b ON g.page = b.page AND g.y >= b.lo GROUP BY 1, 2, 3"""


@query("page_cells", PAGE_CELLS)
def page_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells by row and column: rows from the lines of the first column, columns from each page's own edges."""
    g = glyphs(spark, sf)
    page = F.col("page")
    edges = g.select("page").distinct().select("page", F.explode(F.array(F.lit(0.0), (100.0 + 10 * (page % 4)).cast("double"), F.lit(250.0), F.lit(400.0), F.lit(510.0))).alias("edge"))
    return L.page_cells(g, "page", "y", "x", "t", edges, 3.0)


@query("kept_edges", f"""WITH RECURSIVE {GLYPHS}, ys AS MATERIALIZED (SELECT DISTINCT page, y FROM glyphs), k AS (SELECT page, min(y) AS y FROM ys GROUP BY 1 UNION ALL SELECT k.page, min(ys.y) AS y FROM k JOIN ys ON ys.page = k.page AND ys.y - k.y > 20 GROUP BY k.page, k.y)
SELECT page, n, kept, round(last, 4) AS last FROM (SELECT page, count(*) AS n FROM ys GROUP BY 1) JOIN (SELECT page, count(*) AS kept, max(y) AS last FROM k GROUP BY 1) USING (page)""")
def kept_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A fold over sorted edges, each compared with the last one kept."""
    g = glyphs(spark, sf).groupBy("page").agg(F.collect_set("y").alias("ys"))
    e = L.kept_edges(F.col("ys"), 20.0)
    return g.select("page", F.size("ys").cast("long").alias("n"), F.size(e).cast("long").alias("kept"), F.round(F.array_max(e), 4).alias("last"))


@query("latest_observation", "SELECT event_type, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS latest FROM events GROUP BY 1")
def latest_observation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.max(F.col("ts").cast("date")).cast("string").alias("latest"))


@query("ranked_pick", "SELECT k.k AS grp, max(struct_pack(m := m, k2 := k2)).k2 AS best FROM (SELECT p_size % 5 AS k, round(avg(p_retailprice), 0) AS m, p_size AS k2 FROM part GROUP BY p_size) k GROUP BY 1")
def ranked_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Best by margin, ties to the larger number: the maximum of a struct."""
    m = table(spark, sf, "part").groupBy("p_size").agg(F.round(F.avg("p_retailprice"), 0).alias("m"))
    return m.groupBy((F.col("p_size") % 5).alias("grp")).agg(F.max(F.struct("m", F.col("p_size").alias("k2"))).alias("b")).select("grp", F.col("b.k2").alias("best"))


@query("quality_gates", "SELECT 'documents have text' AS gate, count(*) FILTER (text IS NULL) = 0 AS passed FROM documents UNION ALL SELECT 'labels name documents', count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'regions reconcile', (SELECT count(*) FROM nation) = (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey)")
def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.operators.checks import Check, report

    docs, labels, nation = table(spark, sf, "documents"), table(spark, sf, "labels"), table(spark, sf, "nation")
    return report([
        Check("documents have text", docs.filter("text is null")),
        Check("labels name documents", labels.join(docs, "doc_id", "left_anti")),
        Check("regions reconcile", nation.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti")),
    ])
