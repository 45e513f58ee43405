"""Sources read as text: pages with links and tables, strict daily files, files with a preamble, declared encodings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.functions.columns import dashed_number, size_bytes, stripped_tags


def links(pages: DataFrame, key: str, html: str, pattern: str = r'<a href="([^"]*)">([^<]*)</a>') -> DataFrame:
    """key, url, label, pos of each page's links; of links with one URL the first stays."""
    found = pages.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))).alias("pos", "l"))
    first = F.row_number().over(Window.partitionBy(key, "l.url").orderBy("pos"))
    return found.withColumn("i", first).filter("i = 1").select(key, "l.url", "l.label", F.col("pos").cast("long").alias("pos"))


def table_rows(pages: DataFrame, key: str, html: str, cells: int) -> DataFrame:
    """key, row, cell texts (array) of each page's table rows that have so many cells."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "body"))
    texts = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), stripped_tags)
    return rows.select(key, F.col("row").cast("long").alias("row"), texts.alias("cells")).filter(F.size("cells") == cells)


def archive_listing(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, prefecture, year, file, bytes from five-cell rows that name an archive; size text in KB, MB or GB."""
    name = r"^A40-(\d\d)_(\d\d)_GML\.zip$"
    rows = table_rows(pages, key, html, 5).filter(F.col("cells")[4].rlike(name))
    return rows.select(key, F.col("cells")[0].alias("prefecture"), (F.regexp_extract(F.col("cells")[4], name, 1).cast("int") + 2000).alias("year"), F.col("cells")[4].alias("file"), size_bytes(F.col("cells")[3]).alias("bytes"))


def paired_codes(pages: DataFrame, key: str, html: str, least: int = 0) -> DataFrame:
    """number, name, page of areas whose number stands twice (a back reference); the first page that names one counts.

    With ``least`` it raises if there are fewer areas, or if one number has two names.
    """
    pattern = r'<td[^>]*>(\d+)</td>\s*<td[^>]*>([^<]+)</td>\s*<td[^>]*><a href="area\1\.html">'
    found = pages.select(key, F.explode(F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("number"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("name"))).alias("a"))
    out = found.groupBy(F.col("a.number").cast("int").alias("number")).agg(F.min_by("a.name", key).alias("name"), F.min(key).alias("page"), F.count_distinct("a.name").alias("names"))
    if least:
        n = out.agg(F.count("*").alias("n"), F.coalesce(F.max("names"), F.lit(0)).alias("names")).first()
        if n.n < least or n.names > 1:
            raise ValueError(f"{n.n} areas, at least {least} were expected" if n.n < least else "a number has two names")
    return out.drop("names")


DAILY_COLUMNS = "area string, d date, flag string, temp double"


def daily_files(spark: SparkSession, path: str, low: float = -5.0, high: float = 40.0, missing: float = -9999.0) -> tuple[DataFrame, DataFrame]:
    """Days (area, d, flag, temp) and the lines set aside with a reason, from ``yyyy,mm,dd,area,flag,temp`` text.

    Blank lines and headers are skipped. A line needs six columns, its file's area, a valid date, a known flag, a value in range
    and no second line of its day in its file; missing values are dropped after that test.
    """
    raw = spark.read.text(path).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).alias("file_area"))
    raw = raw.filter((F.trim("value") != "") & ~F.col("value").startswith("yyyy"))
    p = F.split("value", ",")
    part = lambda i: F.trim(F.try_element_at(p, F.lit(i + 1)))
    row = raw.select("value", "file_area", F.size(p).alias("n"), part(3).alias("area"), part(4).alias("flag"), F.try_to_date(F.concat_ws("-", part(0), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))).alias("d"), part(5).try_cast("double").alias("temp"))
    twice = F.count("*").over(Window.partitionBy("file_area", "area", "d", F.col("temp") != missing))
    reason = (
        F.when(F.col("n") != 6, "columns").when(F.col("area") != F.col("file_area"), "area").when(F.col("d").isNull(), "date").when(~F.col("flag").isin("P", "R"), "flag")
        .when(F.col("temp").isNull(), "value").when((F.col("temp") != missing) & ~F.col("temp").between(low, high), "range").when((twice > 1) & (F.col("temp") != missing), "duplicate")
    )
    judged = row.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull() & (F.col("temp") != missing)).select("area", "d", "flag", "temp"), judged.filter("reason is not null").select("value", "file_area", "reason")


def normal_files(spark: SparkSession, path: str) -> DataFrame:
    """area, month, day, normal, period: the period comes from the file's head, rows without a number for month or day go."""
    raw = spark.read.text(path).select(F.col("value"), F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).alias("area"))
    period = raw.groupBy("area").agg(F.max(F.nullif(F.regexp_extract("value", r"Period of Norm\. : (\d+-\d+)", 1), F.lit(""))).alias("period"))
    p = F.split("value", ",")
    rows = raw.filter(F.size(p) == 8).select("area", F.trim(p[0]).try_cast("int").alias("month"), F.trim(p[1]).try_cast("int").alias("day"), F.trim(p[2]).try_cast("double").alias("normal")).filter("month is not null and day is not null")
    return rows.join(period, "area")


def fixed_numbers(lines: DataFrame, column: str, n: int, picks: dict[str, int]) -> DataFrame:
    """name and picked numbers of lines that are a name and ``n`` numbers (dashes are 0, commas go), or numbers alone, which are sums and have no name; other lines go."""
    number = r"(?:[\d,]+|[-－―])"
    pattern = rf"^\s*(?:(\D+?)\s+)?({number}(?:\s+{number}){{{n - 1}}})\s*$"
    parts = F.split(F.regexp_extract(column, pattern, 2), r"\s+")
    return lines.filter(F.col(column).rlike(pattern)).select(F.nullif(F.trim(F.regexp_extract(column, pattern, 1)), F.lit("")).alias("name"), *[dashed_number(parts[i]).alias(k) for k, i in picks.items()])


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes by the encoding that an XML declaration names, else strict UTF-8, else cp932."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        m = re.match(rb"""\s*<\?xml[^>]*encoding=["']([\w.-]+)["']""", b)
        for encoding in ([m[1].decode()] if m else []) + ["utf-8", "cp932"]:
            try:
                return b.decode(encoding)
            except (UnicodeDecodeError, LookupError):
                continue
        return None

    return content.map(one)


def declared_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, bytes, digest of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def file_manifest(spark: SparkSession, wanted: DataFrame, path: str, key: str = "file") -> DataFrame:
    """``wanted`` (names in ``key``) with path, bytes and digest of the file of that name, null where there is none, and status."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias(key), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
    return wanted.join(files, key, "left").withColumn("status", F.when(F.col("path").isNull(), "missing").otherwise("present"))


def listed_lines(spark: SparkSession, manifest: DataFrame, kind: str, without: tuple[str, ...], path: str = "path") -> DataFrame:
    """path, line of all text files that a manifest lists, but for those whose ``kind`` is in ``without`` and those that are missing."""
    # A manifest is a list of files, so it is small.
    paths = [r[0] for r in manifest.filter(~F.col(kind).isin(*without) & F.col(path).isNotNull()).select(path).distinct().orderBy(path).collect()]
    if not paths:
        return spark.createDataFrame([], "path string, line string")
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def footnote_names(lines: DataFrame, column: str, heading: str) -> DataFrame:
    """name, pos of the list that follows a heading and a colon on its line; commas and middle dots part the names."""
    rest = F.regexp_extract(column, rf"{heading}[：:]\s*(.+)", 1)
    return lines.filter(rest != "").select(F.posexplode(F.split(rest, "[・、]")).alias("pos", "name")).select(F.trim("name").alias("name"), F.col("pos").cast("long").alias("pos")).filter("name <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text of all lines of text files, blank ones too.

    Large files are read in splits; a split's first number is the count of lines in the splits of its file before it.
    """
    m = F.col("_metadata")
    raw = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    sizes = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(sizes.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")
