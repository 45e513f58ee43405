"""Queries of sources and sinks: files are written from the tables, read back by the source, and must give what SQL says of the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import columns as C
from lodestar.operators import oplog as O
from lodestar.operators import publish as P
from lodestar.operators import spatial as G
from lodestar.sources import shape_source as R
from lodestar.sources import shapes as S
from lodestar.sources import text as T

from . import geo_queries
from .registry import query
from .tables import folder, table


def placed(spark: SparkSession, df: DataFrame, tag: str, suffix: str) -> str:
    """Writes ``key`` and ``body`` (text or binary) as one file per key; the folder."""
    at = folder(spark, tag)
    body = F.col("body") if df.schema["body"].dataType.simpleString() == "binary" else F.encode("body", "UTF-8")
    P.files_by_key(df.select("key", body.alias("body")), at, suffix).agg(F.sum("bytes")).collect()
    return at


def joined(order: Column | str, line: str) -> Column:
    """The group's lines in order, each ended by a line feed."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order) if isinstance(order, str) else order, line))), lambda r: r[line])
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


# Pages ----------------------------------------------------------------------------------------------------------------


@query("paired_codes", "SELECT CAST(100 + n_nationkey AS INTEGER) AS number, n_name AS name, min(n_regionkey) AS page FROM nation GROUP BY 1, 2")
def paired_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Areas whose number stands twice on a page (a back reference); pages repeat areas, the first page that names one counts."""
    n = table(spark, sf, "nation").withColumn("page", F.explode(F.array("n_regionkey", F.col("n_regionkey") + 10)))
    number = (100 + F.col("n_nationkey")).cast("string")
    cell = lambda link: F.concat(F.lit("<td class=c>"), number, F.lit("</td>\n <td>"), "n_name", F.lit('</td><td><a href="area'), link, F.lit('.html">x</a></td>'))
    rows = n.select("page", "n_nationkey", F.concat(cell(number), cell(F.concat(number, F.lit("9")))).alias("cells"))
    pages = rows.groupBy("page").agg(joined("n_nationkey", "cells").alias("html"))
    return T.paired_codes(pages, "page", "html", 20)


@query("archive_listing", "SELECT CAST(s_suppkey // 20 AS BIGINT) AS page, 'Area ' || s_nationkey || ' & co' AS prefecture, CAST(2012 + s_suppkey % 9 AS INTEGER) AS year, 'A40-' || CAST(12 + s_suppkey % 9 AS VARCHAR) || '_' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || '_GML.zip' AS file, CAST(round((1 + s_suppkey % 900) * CASE s_suppkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 ELSE 1073741824 END) AS BIGINT) AS bytes FROM supplier WHERE s_suppkey % 5 <> 0")
def archive_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a page's table that name an archive: entities, tags within cells and sizes in three units; other rows are left out."""
    k = F.col("s_suppkey")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("KB", "MB", "GB")]), (k % 3 + 1).cast("int"))
    name = F.when(k % 5 == 0, F.concat(F.lit("A40-"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("A40-"), 12 + k % 9, F.lit("_"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit("_GML.zip")))
    cells = [F.concat(F.lit("<b>Area "), "s_nationkey", F.lit("</b> &amp;\n co")), F.lit("-"), F.lit("2024"), F.concat((1 + k % 900).cast("string"), unit), name]
    row = F.concat(F.lit("<tr class=r>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    pages = table(spark, sf, "supplier").select(F.floor(k / 20).alias("page"), k.alias("k"), row.alias("row")).groupBy("page").agg(joined("k", "row").alias("html"))
    return T.archive_listing(pages, "page", "html")


@query("fetch_plan", "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS area, CASE WHEN abs(s_acctbal) > 0.03 * 5000 THEN true ELSE false END AS differs FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey % 4 = 0")
def fetch_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Only files that may be redistributed are fetched; those whose size is over 3 % off what their page says are marked."""
    listing = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("area"), F.lit(5000.0).alias("said"), (5000.0 + F.col("s_acctbal")).alias("found"))
    policies = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("area"), F.element_at(F.array(*[F.lit(x) for x in ("redistribute", "link_only", "not_provided", "no_data")]), (F.col("n_regionkey") % 4 + 1).cast("int")).alias("policy"))
    plan = P.fetch_plan(listing, policies, "area", "policy", "redistribute")
    off = P.size_differs(plan, "said", "found").select("id", F.lit(True).alias("differs"))
    return plan.select("id", "area").join(off, "id", "left").withColumn("differs", F.coalesce("differs", F.lit(False)))


# Text files -----------------------------------------------------------------------------------------------------------


@query("fixed_numbers", "SELECT 'Area ' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'abcdefghij') AS name, CAST(n_nationkey * 1234 AS BIGINT) AS total, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey END AS BIGINT) AS first, CAST(n_regionkey AS BIGINT) AS last FROM nation UNION ALL SELECT NULL, CAST(sum(n_nationkey * 1234) AS BIGINT), CAST(sum(CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey END) AS BIGINT), CAST(sum(n_regionkey) AS BIGINT) FROM nation")
def fixed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a name and fifteen numbers, with thousands separators and dashes for nothing; the line of sums has no name, titles have another shape."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("Area "), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    numbers = [F.format_number(k * 1234, 0), F.lit("1"), F.lit("2"), F.when(k % 4 == 0, "－").otherwise(k.cast("string")), *[F.lit("-")] * 10, F.col("n_regionkey").cast("string")]
    lines = table(spark, sf, "nation").select(F.concat_ws("  ", name, *numbers).alias("line"))
    sums = table(spark, sf, "nation").agg(F.format_number(F.sum(k * 1234), 0).alias("a"), F.sum(F.when(k % 4 == 0, 0).otherwise(k)).cast("string").alias("b"), F.sum("n_regionkey").cast("string").alias("c"))
    others = spark.createDataFrame([("Title of the table",), ("Area z 1 2 3",)], "line string").unionByName(sums.select(F.concat_ws("  ", "a", F.lit("1"), F.lit("2"), "b", *[F.lit("-")] * 10, "c").alias("line")))
    return T.fixed_numbers(lines.unionByName(others), "line", 15, {"total": 0, "first": 3, "last": 14})


FOOTNOTE = "SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation WHERE n_regionkey = 1"


@query("footnote_names", FOOTNOTE)
def footnote_names(spark: SparkSession, sf: str) -> DataFrame:
    """The names that a footnote lists after its heading."""
    n = table(spark, sf, "nation").filter("n_regionkey = 1")
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: r["n_name"])
    note = n.agg(F.concat(F.lit("注 特定第３種漁港： "), F.element_at(names, 1), F.lit("・"), F.array_join(F.slice(names, 2, 99), "、")).alias("line"))
    return T.footnote_names(note.unionByName(spark.createDataFrame([("another line",)], "line string")), "line", "特定第３種漁港")


@query("official_sums", "WITH c AS (SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT n_name FROM nation WHERE n_regionkey = 1) SELECT 'classes add up' AS gate, (SELECT sum(n) FROM c) = (SELECT count(*) FROM orders) AS passed UNION ALL SELECT 'the list is complete', (SELECT count(DISTINCT n_name) FROM f) = (SELECT count(*) FROM f) UNION ALL SELECT 'control: a class is missing', (SELECT sum(n) FROM c WHERE class <> 'F') = (SELECT count(*) FROM orders)")
def official_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Printed tables agree with themselves: classes add up to the total, a footnote's list is as long as its count; the control must fail."""
    from lodestar.operators.checks import Check, report

    classes = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    total = table(spark, sf, "orders").agg(F.count("*").alias("total"))
    off = lambda some: some.agg(F.sum("n").alias("n")).crossJoin(total).filter("n <> total")
    listed = footnote_names(spark, sf).agg(F.count("*").alias("n")).crossJoin(table(spark, sf, "nation").filter("n_regionkey = 1").agg(F.count("*").alias("said")))
    return report([Check("classes add up", off(classes)), Check("the list is complete", listed.filter("n <> said")), Check("control: a class is missing", off(classes.filter("o_orderstatus <> 'F'")))])


DAILY = """o AS (SELECT o_custkey // 250 AS area, CAST(o_orderdate AS DATE) AS d, min(o_totalprice) % 30 AS temp, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN k % 50 = 1 THEN 'columns' WHEN k % 50 = 2 THEN 'area' WHEN k % 50 = 3 THEN 'date' WHEN k % 50 = 4 THEN 'flag' WHEN k % 50 = 5 THEN 'value' WHEN k % 50 = 6 THEN 'range' WHEN k % 50 = 7 THEN 'duplicate' WHEN k % 50 = 8 THEN 'missing' END AS reason FROM o)"""


def _daily(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Daily files, one for each 250 customers, in which every fiftieth line or so has each of the known faults."""
    o = table(spark, sf, "orders").groupBy(F.floor(F.col("o_custkey") / 250).alias("area"), F.col("o_orderdate").cast("date").alias("d")).agg((F.min("o_totalprice") % 30).alias("temp"), F.min("o_orderkey").alias("k"))
    k = F.col("k") % 50
    area = F.when(k == 2, F.col("area") + 1).otherwise(F.col("area")).cast("string")
    temp = F.when(k == 5, F.lit("warm")).when(k == 6, F.lit("99.5")).when(k == 8, F.lit("-9999")).otherwise(F.round("temp", 2).cast("string"))
    parts = [F.year("d"), F.month("d"), F.when(k == 3, F.lit(32)).otherwise(F.day("d")), area, F.when(k == 4, F.lit("X")).when(k % 2 == 0, F.lit("P")).otherwise(F.lit("R")), temp]
    line = F.concat(F.concat_ws(",", *parts), F.when(k == 1, F.lit(",7")).otherwise(F.lit("")))
    lines = o.select(F.col("area").alias("key"), "d", F.when(k == 7, F.concat(line, F.lit("\n"), line)).otherwise(line).alias("line"))
    body = lines.groupBy("key").agg(F.concat(F.lit("yyyy,mm,dd,areaNo.,flag,Temp.\n\n"), joined("d", "line")).alias("body"))
    return T.daily_files(spark, placed(spark, body.select(F.concat(F.lit("area"), "key").alias("key"), "body"), "daily", ".txt"))


@query("daily_scan", f"WITH {DAILY} SELECT CAST(area AS VARCHAR) AS area, d, CASE WHEN k % 2 = 0 THEN 'P' ELSE 'R' END AS flag, round(temp, 2) AS temp FROM r WHERE reason IS NULL")
def daily_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf)[0]


@query("daily_quarantine", f"WITH {DAILY} SELECT CAST(area AS VARCHAR) AS file_area, reason, CAST(sum(CASE WHEN reason = 'duplicate' THEN 2 ELSE 1 END) AS BIGINT) AS n FROM r WHERE reason IS NOT NULL AND reason <> 'missing' GROUP BY 1, 2")
def daily_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that were set aside, by reason."""
    return _daily(spark, sf)[1].groupBy("file_area", "reason").agg(F.count("*").alias("n"))


@query("normal_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS area, CAST(m.m AS INTEGER) AS month, CAST(1 + n_nationkey % 28 AS INTEGER) AS day, n_nationkey + m.m / 4.0 AS normal, CAST(1981 + n_regionkey AS VARCHAR) || '-2010' AS period FROM nation CROSS JOIN range(1, 13) m(m)")
def normal_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose head names the period and whose rows of eight columns hold the normals; other rows have no numbers."""
    n = table(spark, sf, "nation").withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
    line = F.concat_ws(", ", "m", 1 + F.col("n_nationkey") % 28, F.col("n_nationkey") + F.col("m") / 4.0, *[F.lit("0")] * 5)
    head = F.concat(F.lit("Some text\nPeriod of Norm. : "), 1981 + F.first("n_regionkey"), F.lit("-2010\nmm,dd,a,b,c,d,e,f\n"))
    body = n.withColumn("line", line).groupBy(F.concat(F.lit("stat"), "n_nationkey").alias("key")).agg(F.concat(head, joined("m", "line")).alias("body"))
    return T.normal_files(spark, placed(spark, body, "normal", ".txt"))


@query("file_manifest", "SELECT 'n' || n_nationkey || '.txt' AS file, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(strlen(n_name) AS BIGINT) END AS bytes, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE sha256(n_name) END AS digest, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' ELSE 'present' END AS status FROM nation")
def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What is there of the files that a list asks for; a missing one is a row with a status, not an error."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("body"), "n_nationkey")
    at = placed(spark, n.filter("n_nationkey % 4 <> 0").drop("n_nationkey"), "manifest", ".txt")
    return T.file_manifest(spark, n.select(F.concat("key", F.lit(".txt")).alias("file")), at).select("file", "bytes", "digest", "status")


@query("listed_lines", "SELECT n_nationkey AS id, n_name AS line FROM nation WHERE n_regionkey NOT IN (2, 3) AND n_nationkey % 4 <> 0")
def listed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the files that a manifest lists, without two kinds and without those that are missing."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat("n_nationkey", F.lit(" "), "n_name").alias("body"), "n_nationkey", "n_regionkey")
    at = placed(spark, n.filter("n_nationkey % 4 <> 0").select("key", "body"), "listed", ".txt")
    manifest = T.file_manifest(spark, n.select(F.concat("key", F.lit(".txt")).alias("file"), F.col("n_regionkey").cast("string").alias("kind")), at)
    p = F.split("line", " ")
    return T.listed_lines(spark, manifest, "kind", ("2", "3")).select(p[0].cast("int").alias("id"), p[1].alias("line"))


@query("declared_encodings", "SELECT n_nationkey AS id, '港 ' || n_name || ' なお、' AS note, CASE n_nationkey % 3 WHEN 0 THEN 'shift_jis' WHEN 1 THEN 'utf-8' ELSE 'euc-jp' END AS encoding FROM nation")
def declared_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """XML files in the encoding that each declares; the sentence that holds a word is taken from its text."""

    @F.arrow_udf("binary")
    def encoded(text: pa.Array, name: pa.Array) -> pa.Array:
        return pa.array([t.as_py().encode(e.as_py()) for t, e in zip(text, name, strict=True)], pa.binary())

    name = F.element_at(F.array(*[F.lit(x) for x in ("shift_jis", "utf-8", "euc-jp")]), (F.col("n_nationkey") % 3 + 1).cast("int"))
    text = F.concat(F.lit('<?xml version="1.0" encoding="'), name, F.lit('"?><a><b>other</b><note>港 '), "n_name", F.lit(" なお、</note></a>"))
    at = placed(spark, table(spark, sf, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("key"), encoded(text, name).alias("body")), "xml", ".xml")
    found = T.declared_files(spark, at)
    return found.select(F.regexp_extract("path", r"x(\d+)\.xml$", 1).cast("int").alias("id"), F.regexp_extract("text", "<note>([^<]*なお、)", 1).alias("note"), F.regexp_extract("text", 'encoding="([^"]+)"', 1).alias("encoding"))


JSONL = "SELECT 'log' || CAST(event_id // 400 AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY event_id // 400 ORDER BY event_id) AS BIGINT) AS line, event_id, event_type FROM events"


def _logs(spark: SparkSession, sf: str) -> str:
    """JSON lines of events in files of four hundred; every seventh is broken, every eleventh has a blank line before it."""
    e = table(spark, sf, "events")
    record = F.to_json(F.struct(F.lit("1").alias("v"), F.col("event_id").cast("string").alias("loop_id"), F.col("event_type").alias("event")))
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{broken "), "event_id")).otherwise(record)
    lines = e.select(F.concat(F.lit("log"), F.floor(F.col("event_id") / 400)).alias("key"), "event_id", line.alias("line"))
    return placed(spark, lines.groupBy("key").agg(joined("event_id", "line").alias("body")), "jsonl", ".jsonl")


@query("jsonl_scan", f"WITH l AS ({JSONL}) SELECT file, line, CASE WHEN event_id % 7 <> 0 THEN event_id END AS id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event FROM l")
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their line numbers; lines that are no JSON have none."""
    got = O.read_jsonl(spark, _logs(spark, sf))
    return got.select(F.regexp_extract("file", r"(log\d+)\.jsonl$", 1).alias("file"), "line", F.col("record.loop_id").cast("long").alias("id"), F.col("record.event").alias("event"))


@query("json_documents", "SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON file per key, written and read back whole."""
    at = folder(spark, "documents")
    P.one_file_per_key(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "id", at).agg(F.sum("bytes")).collect()
    return T.json_documents(spark, at).select(F.col("id").cast("int").alias("id"), "name", "region")


# Shapefiles -----------------------------------------------------------------------------------------------------------


def _archives(spark: SparkSession, sf: str, kind: int) -> str:
    """A zipped shapefile for each version of each two hundred boxes, with names in one of two encodings."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ring = lambda r: [[[r["x0"], r["y0"]], [r["x1"], r["y0"]], [r["x1"], r["y1"]], [r["x0"], r["y1"]], [r["x0"], r["y0"]]]]
                data = S.archive(f"v{key}", [(r["box_id"], f"約{r['rank']}m", ring(r)) for r in rows], ["ID", "LABEL"], "utf-8" if int(key[-1]) % 2 else "cp932", kind)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([data], pa.binary())], ["key", "body"])

    b = geo_queries.boxes(spark, sf)
    groups = b.groupBy(F.concat_ws("-", F.floor(F.col("box_id") / 200), "version").alias("key")).agg(F.array_sort(F.collect_list(F.struct("box_id", "rank", "x0", "y0", "x1", "y1"))).alias("rows"))
    return placed(spark, groups.mapInArrow(pack, "key string, body binary"), "shapes", ".zip")


@query("archive_shapes", f"WITH {geo_queries.BOXES} SELECT version, CAST(row_number() OVER (PARTITION BY version, box_id // 200 ORDER BY box_id) - 1 AS BIGINT) AS record, box_id, '約' || rank || 'm' AS label, x0, y0, x1, y1, CAST(5 AS BIGINT) AS points FROM boxes")
def archive_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons with their attributes from zipped shapefiles; the text's encoding is told by its content."""
    s = S.read_archives(spark, _archives(spark, sf, 5))
    return s.select(F.regexp_extract("path", r"-(\d+)\.zip$", 1).cast("int").alias("version"), "record", F.col("attributes")["ID"].cast("long").alias("box_id"), F.col("attributes")["LABEL"].alias("label"), "x0", "y0", "x1", "y1", F.size(F.element_at("rings", 1)).cast("long").alias("points"))


@query("header_boxes", f"WITH {geo_queries.BOXES} SELECT version, CAST(row_number() OVER (PARTITION BY version, box_id // 200 ORDER BY box_id) - 1 AS BIGINT) AS record, x0, y0, x1, y1 FROM boxes")
def header_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes alone, from record headers."""
    s = S.read_boxes(spark, _archives(spark, sf, 5))
    return s.select(F.regexp_extract("path", r"-(\d+)\.zip$", 1).cast("int").alias("version"), "record", "x0", "y0", "x1", "y1")


@query("shapes_in_box", f"WITH {geo_queries.BOXES} SELECT version, CAST(row_number() OVER (PARTITION BY version, box_id // 200 ORDER BY box_id) - 1 AS BIGINT) AS record, box_id, '約' || rank || 'm' AS label, CAST(5 AS BIGINT) AS points, x0, y0, x1, y1 FROM boxes QUALIFY x1 >= 137.01 AND x0 <= 137.02 AND y1 >= 35.01 AND y0 <= 35.02")
def shapes_in_box(spark: SparkSession, sf: str) -> DataFrame:
    """Polygons whose boxes touch a window: the filter reaches the source, which reads only their bodies and attributes."""
    s = R.scan(spark, _archives(spark, sf, 5), columns=["ID", "LABEL"]).filter("x1 >= 137.01 and x0 <= 137.02 and y1 >= 35.01 and y0 <= 35.02")
    return s.select(F.regexp_extract("path", r"-(\d+)\.zip$", 1).cast("int").alias("version"), "record", F.col("attributes")["ID"].cast("long").alias("box_id"), F.col("attributes")["LABEL"].alias("label"), F.size(F.element_at("rings", 1)).cast("long").alias("points"), "x0", "y0", "x1", "y1")


@query("boundary_means", f"WITH {geo_queries.BOXES} SELECT rank AS code, round(avg((3 * x0 + 2 * x1) / 5), 6) AS lon, round(avg((3 * y0 + 2 * y1) / 5), 6) AS lat, count(*) AS lines FROM boxes GROUP BY 1")
def boundary_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vertex of all boundary lines of a code, from polylines."""
    s = S.read_archives(spark, _archives(spark, sf, 3)).select(F.regexp_extract(F.col("attributes")["LABEL"], r"(\d+)", 1).cast("int").alias("code"), F.explode(F.flatten("rings")).alias("p"), F.concat_ws("/", "path", "record").alias("line"))
    return s.groupBy("code").agg(F.round(F.avg(F.col("p")[0]), 6).alias("lon"), F.round(F.avg(F.col("p")[1]), 6).alias("lat"), F.countDistinct("line").alias("lines"))


# Polygons -------------------------------------------------------------------------------------------------------------


def _ringed(boxes: DataFrame) -> DataFrame:
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    return boxes.withColumn("rings", F.array(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))))


@query("polygon_join", f"WITH {geo_queries.POINTS}, {geo_queries.BOXES}, {geo_queries.PAIRS.format(r=500)} SELECT id, box_id, round(distance, 3) AS distance FROM pairs")
def polygon_join(spark: SparkSession, sf: str) -> DataFrame:
    """Points and the polygons that a disc of 500 m around them touches, by the polygons' edges; SQL measures the same rectangles as boxes."""
    once, members = G.places(geo_queries.points(spark, sf), ["pref"])
    near = G.near_polygons(once, _ringed(geo_queries.boxes(spark, sf)), 500.0, 0.01, ["pref"])
    return G.of_points(near.select("id", "box_id", F.round("distance", 3).alias("distance")), members)


@query("polygon_parts", f"WITH {geo_queries.BOXES} SELECT box_id, CAST(CASE box_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS BIGINT) AS rings, round(CASE box_id % 4 WHEN 2 THEN NULL ELSE x0 END, 6) AS x0 FROM boxes")
def polygon_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Collections without their lines and points, with coordinates rounded to six decimals."""
    b = _ringed(geo_queries.boxes(spark, sf))
    part = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("rings"))
    kinds = ((part("Polygon"),), (part("LineString"), part("MultiPolygon"), part("Polygon")), (part("LineString"), part("Point")), (part("Polygon"), part("Point")))
    parts = F.coalesce(*[F.when(F.col("box_id") % 4 == i, F.array(*k)) for i, k in enumerate(kinds)])
    rings = b.select("box_id", C.rounded_rings(G.polygon_parts(parts)).alias("r"))
    return rings.select("box_id", F.size("r").cast("long").alias("rings"), F.when(F.size("r") > 0, F.col("r")[0][0][0]).alias("x0"))


@query("outline_sizes")
def outline_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each point's file of clipped outlines, plain and compressed, and what all boxes would take; tested against gzip."""
    parts, members = geo_queries.clipped_once(spark, sf)
    s = G.outline_sizes(parts, "id", geo_queries.boxes(spark, sf).count(), members)
    return s.select("id", "polygons", "bytes", "gzip_bytes", F.round("all_bytes").cast("long").alias("all_bytes"), F.round("all_gzip_bytes").cast("long").alias("all_gzip_bytes"))


# Sinks ----------------------------------------------------------------------------------------------------------------


@query("whole_document", "SELECT r_regionkey AS id, '港' || r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE CAST(r_regionkey AS BIGINT) END AS v FROM region")
def whole_document(spark: SparkSession, sf: str) -> DataFrame:
    """A small table as one JSON document, read back; nulls stay, characters beyond ASCII aren't escaped."""
    at = folder(spark, "document")
    rows = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("港"), "r_name").alias("name"), F.when(F.col("r_regionkey") % 2 != 0, F.col("r_regionkey")).alias("v"))
    P.document(rows, ["id"], at, "regions").agg(F.sum("bytes")).collect()
    return spark.read.schema("id int, name string, v long").json(at, multiLine=True)


@query("rebuilt_table", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def rebuilt_table(spark: SparkSession, sf: str) -> DataFrame:
    """A full rebuild leaves nothing of what was there."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    at = folder(spark, "rebuilt")
    P.rebuilt(n.filter("n_regionkey <> 2").drop("n_regionkey"), at)
    return P.rebuilt(n.filter("n_regionkey = 2").drop("n_regionkey"), at)


@query("resumed_build", "SELECT s_nationkey AS part, count(*) AS n, CASE WHEN s_nationkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM supplier GROUP BY 1")
def resumed_build(spark: SparkSession, sf: str) -> DataFrame:
    """A build by parts that goes on where it stopped: parts of the first run aren't built again by the second."""
    at, s = folder(spark, "resumed"), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("part"), "s_suppkey")
    build = lambda run: lambda todo: s.join(todo, "part").groupBy("part").agg(F.count("*").alias("n")).withColumn("run", F.lit(run))
    wanted = s.select("part").distinct()
    P.resumed(wanted.filter("part % 3 = 0"), at, "part", build("first"))
    done, _ = P.resumed(wanted, at, "part", build("second"))
    return done.select("part", "n", "run")


@query("optional_sections", "SELECT r_regionkey AS id, NULL::DOUBLE AS value, 'missing_source' AS status, 'none' AS build FROM region UNION ALL SELECT r_regionkey, CASE WHEN r_regionkey < 3 THEN r_regionkey / 2.0 END, CASE WHEN r_regionkey < 3 THEN 'estimated' ELSE 'not_available' END, 'there' FROM region")
def optional_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A section whose product isn't there has a status, no error."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"))
    product = r.filter("id < 3").withColumn("v", F.col("id") / 2.0)
    show = lambda df, build: df.select("id", "section.value", "section.status", F.lit(build).alias("build"))
    return show(P.optional_section(r, None, "id", "v"), "none").unionByName(show(P.optional_section(r, product, "id", "v"), "there"))


@query("dataset_manifest", "SELECT 'nations' AS dataset, count(*) AS rows FROM nation UNION ALL SELECT 'regions', count(*) FROM region UNION ALL SELECT 'none', 0")
def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of the datasets that exist, in one job; one that doesn't exist has no row."""
    n = table(spark, sf, "nation")
    return P.manifest_rows({"nations": n, "regions": table(spark, sf, "region"), "none": n.limit(0), "absent": None})


@query("log_csv", "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN event_type || ', \"x\"' ELSE '' END AS a, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS b FROM events ")
def log_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Logs as one CSV file with the union of their keys, read back."""
    e = table(spark, sf, "events")
    data = F.map_filter(F.create_map(F.lit("b"), F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")), F.lit("a"), F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(', "x"')))), lambda k, v: v.isNotNull())
    at = folder(spark, "csv")
    P.csv_with_union(e.select(F.col("event_id").alias("id"), data.alias("data")), ["id"], "data", ["id"], at)
    got = spark.read.csv(at, header=True, quote='"', escape='"', encoding="UTF-8")
    first = got.columns[0]  # a byte-order mark may stand before it
    return got.select(F.col(f"`{first}`").alias("id"), F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))


#: Logs of forty rows, the first twelve of which are there; the others are judged one by one, each by those that stand.
KINDS = ("loop_start", "stage_end", "test_run", "failure", "commit", "loop_end")
LOGS = """e AS (SELECT event_id // 40 AS file, event_id % 40 + 1 AS line, (user_id * 31 + event_id * 17) % 100 AS h, CASE WHEN (event_id * 13 + user_id) % 23 = 0 THEN 'q' ELSE 'p' END AS project, ts, value FROM events),
logs AS (SELECT file, line, project, CASE WHEN line = 1 THEN 'loop_start' WHEN h < 14 THEN 'correction' WHEN line > 25 AND h >= 88 THEN 'loop_end' WHEN h < 45 THEN 'failure' WHEN h < 65 THEN 'test_run' WHEN h < 78 THEN 'commit' WHEN h < 84 THEN 'stage_end' WHEN h < 88 THEN 'note' ELSE 'commit' END AS event,
  CASE WHEN line > 1 AND h < 14 THEN line - 5 + h % 7 END AS supersedes, CASE WHEN h % 10 <> 9 THEN h END AS code, line <= 12 AS there, ts, value FROM e)"""
ADMIT = f"""{LOGS},
fold AS (SELECT file, CAST(0 AS BIGINT) AS line, CAST([] AS STRUCT(line BIGINT, event VARCHAR, project VARCHAR)[]) AS eff, CAST([] AS STRUCT(line BIGINT, event VARCHAR)[]) AS seen, CAST([] AS VARCHAR[]) AS voids, CAST(NULL AS VARCHAR) AS verdict FROM (SELECT DISTINCT file FROM logs)
UNION ALL SELECT file, line, CASE WHEN NOT (there OR verdict = 'ok') THEN eff WHEN event <> 'correction' THEN list_append(eff, {{'line': line, 'event': event, 'project': project}}) ELSE list_filter(eff, lambda x: x.line <> coalesce(target.line, -1)) END,
  CASE WHEN there OR verdict = 'ok' THEN list_append(seen, {{'line': line, 'event': event}}) ELSE seen END, CASE WHEN (there OR verdict = 'ok') AND event = 'correction' AND target IS NOT NULL THEN list_append(voids, target.event) ELSE voids END, CASE WHEN NOT there THEN verdict END
FROM (SELECT *, CASE WHEN event NOT IN ('correction', 'loop_start', 'stage_end', 'test_run', 'failure', 'commit', 'loop_end') THEN 'unknown event' WHEN event = 'failure' AND code IS NULL THEN 'missing field'
    WHEN event = 'correction' AND supersedes >= line THEN 'later target' WHEN event = 'correction' AND NOT list_contains(list_transform(seen, lambda x: x.line), supersedes) THEN 'no target'
    WHEN event = 'correction' AND len(list_filter(seen, lambda x: x.line = supersedes AND x.event = 'correction')) > 0 THEN 'target is a correction' WHEN event = 'correction' AND target IS NULL THEN 'corrected before'
    WHEN event = 'correction' THEN CASE WHEN target.event = 'loop_start' AND len(eff) > 1 THEN 'start is followed' ELSE 'ok' END
    WHEN len(eff) > 0 AND eff[1].project <> project THEN 'other project'
    WHEN len(list_filter(eff, lambda x: x.event = 'loop_end')) > 0 AND len(list_filter(seen, lambda x: x.event = r.event AND x.line > list_max(list_transform(list_filter(seen, lambda y: y.event = 'loop_end'), lambda y: y.line)))) >= len(list_filter(voids, lambda x: x = r.event)) THEN 'after the end' ELSE 'ok' END AS verdict
  FROM (SELECT f.file, l.line, l.project, l.event, l.supersedes, l.code, l.there, f.eff, f.seen, f.voids, list_filter(f.eff, lambda x: x.line = l.supersedes AND l.supersedes < l.line)[1] AS target FROM fold f JOIN logs l ON l.file = f.file AND l.line = f.line + 1) r)),
v AS (SELECT l.*, fold.verdict FROM logs l JOIN fold USING (file, line))"""


def _log_rows(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    line, h = e % 40 + 1, (u * 31 + e * 17) % 100
    event = (
        F.when(line == 1, "loop_start").when(h < 14, "correction").when((line > 25) & (h >= 88), "loop_end").when(h < 45, "failure").when(h < 65, "test_run")
        .when(h < 78, "commit").when(h < 84, "stage_end").when(h < 88, "note").otherwise("commit")
    )
    return table(spark, sf, "events").select(
        F.floor(e / 40).alias("file"), line.alias("line"), F.when((e * 13 + u) % 23 == 0, "q").otherwise("p").alias("project"), event.alias("event"), F.when((line > 1) & (h < 14), line - 5 + h % 7).alias("supersedes"),
        F.when(h % 10 != 9, h).alias("code"), (line <= 12).alias("there"), "ts", "value",
    )


NEEDS = {"failure": ("code",)}


@query("log_append", f"WITH RECURSIVE {ADMIT} SELECT file, line, event, supersedes FROM v WHERE there OR verdict = 'ok'")
def log_append(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of JSON lines after an append of the rows that the rules admit."""
    rows = _log_rows(spark, sf).select("file", "line", "project", "event", "supersedes", "code", "there")
    at = folder(spark, "oplog")
    schema = "file long, line long, project string, event string, supersedes long"
    O.appended(rows.filter("there").drop("code", "there"), ["file", "line"], at)
    judged = O.admission(spark.read.schema(schema).json(at), rows.filter("NOT there"), KINDS, NEEDS)
    O.appended(judged.filter("verdict = 'ok'").drop("verdict", "code", "there"), ["file", "line"], at)
    return spark.read.schema(schema).json(at).drop("project")


@query("append_verdicts", f"WITH RECURSIVE {ADMIT} SELECT file, line, verdict FROM v WHERE NOT there")
def append_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows may be appended, and why others may not."""
    rows = _log_rows(spark, sf)
    return O.admission(rows.filter("there"), rows.filter("NOT there"), KINDS, NEEDS).select("file", "line", "verdict")


@query(
    "fact_loops",
    f"""WITH RECURSIVE {ADMIT}, s AS (SELECT * FROM v WHERE there OR verdict = 'ok'), fix AS (SELECT file, supersedes AS line FROM s WHERE event = 'correction' AND supersedes < line), kept AS (SELECT * FROM s WHERE event <> 'correction' AND NOT EXISTS (SELECT 1 FROM fix WHERE fix.file = s.file AND fix.line = s.line))
SELECT file, min(line) AS first, max(line) AS last, count(*) AS n, CAST(count(*) FILTER (event = 'failure') AS BIGINT) AS failures, CAST(count(*) FILTER (event = 'commit') AS BIGINT) AS commits, CAST(count(*) FILTER (event = 'test_run') AS BIGINT) AS tests,
  CAST(arg_max(epoch_us(ts), line) FILTER (event = 'loop_start') AS BIGINT) AS started, arg_max(project, line) FILTER (event = 'loop_start') AS project, CAST(arg_max(epoch_us(ts), line) FILTER (event = 'loop_end') AS BIGINT) AS ended, arg_max(value, line) FILTER (event = 'loop_end') AS outcome, arg_max(value, line) FILTER (event = 'test_run') AS last_test FROM kept GROUP BY file""",
)
def fact_loops(spark: SparkSession, sf: str) -> DataFrame:
    """One row per log of admitted and corrected rows: when and as what it started and ended, counts, what the last test run said."""
    from lodestar.operators.matching import without_voided

    rows = _log_rows(spark, sf)
    stands = rows.filter("there").unionByName(O.admission(rows.filter("there"), rows.filter("NOT there"), KINDS, NEEDS).filter("verdict = 'ok'").drop("verdict"))
    kept = without_voided(stands, "file", "line", "supersedes", F.col("event") == "correction").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return O.facts(
        kept, ["file"], "event", "line", {"failures": "failure", "commits": "commit", "tests": "test_run"},
        {"started": ("loop_start", "at"), "project": ("loop_start", "project"), "ended": ("loop_end", "at"), "outcome": ("loop_end", "value"), "last_test": ("test_run", "value")},
    )


# noqa: E731
    old = e.filter(k % 4 != 3).select(*row(F.when(k % 11 == 0, "correction").otherwise(F.col("event_type")), F.when(k % 11 == 0, k - 5 * (1 + k % 3))))
    new = e.filter(k % 4 == 3).select(*row(F.when(k % 5 == 0, "odd").when(k % 5 == 1, F.col("event_type")).otherwise("correction"), F.when(k % 5 == 4, k + 3).when(k % 5 > 1, k - 5 * (1 + k % 4))))
    return O.admission(old, new, ("click", "view", "error", "purchase", "signup")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("forbidden_columns", "SELECT unnest(['n_name', 'n_regionkey']) AS name")
def forbidden_columns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in P.forbidden(table(spark, sf, "nation"), ["n_name", "n_regionkey", "o_orderkey"])], "name string")


# Small functions ------------------------------------------------------------------------------------------------------


@query("printed_numbers", "SELECT p_partkey AS id, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 ELSE p_size * 1000 END AS BIGINT) AS n, nullif(CASE WHEN p_partkey % 5 = 0 THEN -9999.0 ELSE p_retailprice END, -9999.0) AS v FROM part")
def printed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Dashes are nothing, separators go, a sentinel is null."""
    k = F.col("p_partkey")
    text = F.when(k % 8 == 0, " - ").when(k % 8 == 4, "―").otherwise(F.format_number(F.col("p_size") * 1000, 0))
    return table(spark, sf, "part").select(k.alias("id"), C.dashed_number(text).alias("n"), F.nullif(F.when(k % 5 == 0, -9999.0).otherwise(F.col("p_retailprice")), F.lit(-9999.0)).alias("v"))


@query("name_forms", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE regexp_replace(n_name || CASE n_nationkey % 3 WHEN 1 THEN '県' ELSE '京都府' END, '[県都府]+$', '') END AS stem, CASE WHEN n_nationkey = 7 THEN n_name || '道' ELSE n_name END AS short FROM nation")
def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Stems lose all of some characters at the end; short names lose one, but for one name."""
    k = F.col("n_nationkey")
    long = F.concat("n_name", F.when(k % 3 == 0, "").when(k % 3 == 1, "県").otherwise("京都府"))
    return table(spark, sf, "nation").select(k.alias("id"), C.stem(long, "県都府").alias("stem"), C.short_name(F.concat("n_name", F.lit("道")), "NATION_7道").alias("short"))


@query("slope_texts", "SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN '−' ELSE '+' END || printf('%.3f', abs(s_acctbal)) AS slope, CASE WHEN s_suppkey % 3 = 0 THEN '< 0.000001' ELSE printf('%.3f', (s_suppkey % 97 + 1) / 100.0) END AS p FROM supplier")
def slope_texts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("s_suppkey") % 3 == 0, F.lit(1e-9)).otherwise((F.col("s_suppkey") % 97 + 1) / 100.0)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), C.signed_slope(F.col("s_acctbal")).alias("slope"), C.p_text(p).alias("p"))


@query("run_evidence", r"SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' WHEN 2 THEN 'none' WHEN 3 THEN 'unknown' ELSE 'failed' END AS evidence FROM events")
def run_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What a test run's coloured output shows."""
    text = F.element_at(F.array(*[F.lit(x) for x in ("\x1b[31m3 failed\x1b[0m, 10 passed in 2s", "\x1b[1;32m12 passed\x1b[0m", "no tests ran in 0.01s", "building ...", "1 error during collection")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), O.run_evidence(text).alias("evidence"))


@query("streamed_log", f"WITH RECURSIVE {ADMIT} SELECT file, line, event, supersedes FROM v WHERE verdict = 'ok'")
def streamed_log(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that arrive as files of JSON lines are judged by a stream that keeps each log's state; corrections among them."""
    from lodestar.streaming.log import SCHEMA, follow

    rows = _log_rows(spark, sf).select("file", "line", "project", "event", "supersedes", ((F.col("event") != "failure") | F.col("code").isNotNull()).alias("complete"), "there")
    at = folder(spark, "stream")
    O.appended(rows.filter("there"), ["file", "line"], f"{at}/incoming")
    follow(spark, f"{at}/incoming", f"{at}/log", f"{at}/progress", KINDS)
    O.appended(rows.filter("NOT there"), ["file", "line"], f"{at}/incoming")
    follow(spark, f"{at}/incoming", f"{at}/log", f"{at}/progress", KINDS)
    return spark.read.parquet(f"{at}/log").filter("verdict = 'ok'").select("file", "line", "event", "supersedes")
