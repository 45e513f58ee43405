"""Tables from glyphs on a page: line clustering, rule edges, row and column assignment, ordered cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, by: list[str], y: str, gap: float) -> DataFrame:
    """Adds ``line``: a new one where y is over ``gap`` beyond the member before."""
    w = Window.partitionBy(*by).orderBy(y)
    start = (F.col(y) - F.lag(y).over(w) > gap).cast("int")
    return df.withColumn("__s", F.coalesce(start, F.lit(1))).withColumn("line", F.sum("__s").over(w)).drop("__s")


def line_means(df: DataFrame, by: list[str], y: str, gap: float) -> DataFrame:
    return gap_clusters(df, by, y, gap).groupBy(*by, "line").agg(F.avg(y).alias("y"), F.count("*").alias("n"))


def kept_edges(edges: Column, tolerance: float) -> Column:
    """Sorted edges without those within ``tolerance`` of the last one kept: a fold, since a chain of near edges drifts."""
    return F.aggregate(
        F.array_sort(edges), F.array().cast("array<double>"), lambda acc, e: F.when(F.coalesce(e - F.array_max(acc) > tolerance, F.lit(True)), F.concat(acc, F.array(e))).otherwise(acc)
    )


def row_bands(anchors: DataFrame, by: list[str], y: str) -> DataFrame:
    """Half-open bands between the midpoints of neighbouring anchors: adds lo and hi; the outer ones are open."""
    w = Window.partitionBy(*by).orderBy(y)
    mid = lambda other: (F.col(y) + other) / 2
    return anchors.withColumn("lo", F.coalesce(mid(F.lag(y).over(w)), F.lit(float("-inf")))).withColumn("hi", F.coalesce(mid(F.lead(y).over(w)), F.lit(float("inf"))))


def column_of(x: Column, edges: Column) -> Column:
    """Index of the half-open column that holds x; outside all of them raises."""
    i = F.size(F.filter(edges, lambda e: e <= x))
    return F.when((i > 0) & (i < F.size(edges)), i - 1).otherwise(F.raise_error(F.lit("no column")).cast("int"))


def as_of(rows: DataFrame, steps: DataFrame, by: list[str], at: str, since: str, value: str) -> DataFrame:
    """Rows with ``value`` of the last step of their group that begins at or before them (``since`` <= ``at``), null before the first.

    Both are put in one order and the last step is carried on, so the work is a sort of each group, not a comparison of all rows with all steps. A step that
    begins where a row is counts. Rows with a null ``at`` get null.
    """
    names, kinds = rows.columns, dict(steps.dtypes)
    put = rows.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(kinds[value]).alias("__v"), F.struct(*names).alias("__row"))
    kind = put.schema["__row"].dataType
    marks = steps.select(*by, F.col(since).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__v"), F.lit(None).cast(kind).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return put.unionByName(marks).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__kind = 1").select("__row.*", F.when(F.col("__at").isNotNull(), F.col("__v")).alias(value))


def page_cells(glyphs: DataFrame, page: str, y: str, x: str, text: str, edges: DataFrame, gap: float) -> DataFrame:
    """Tables from glyphs: page, row, col, cell (texts in order of rounded y, then x).

    ``edges`` has page and edge, the borders of a page's columns. Rows follow from the lines of glyphs in the first column: bands are half-open and meet halfway between lines, the first and
    last are open, so what overflows belongs to them. A glyph left of all columns or right of them raises. A page whose first column is empty has null rows.
    """
    kept = edges.select(page, F.col("edge")).distinct()
    numbered = kept.withColumn("col", F.row_number().over(Window.partitionBy(page).orderBy("edge")) - 1)
    count = kept.groupBy(page).agg((F.count("*") - 1).alias("__columns"))
    placed = as_of(glyphs, numbered, [page], x, "edge", "col").join(count, page, "left")
    col = F.when((F.col("col") >= 0) & (F.col("col") < F.col("__columns")), F.col("col")).otherwise(F.raise_error(F.concat(F.lit("no column holds "), F.coalesce(F.col(x).cast("string"), F.lit("null")))).cast("int"))
    placed = placed.withColumn("col", col).drop("__columns")
    lines = row_bands(line_means(placed.filter("col = 0"), [page], y, gap), [page], y).select(page, "lo", (F.col("line") - 1).cast("int").alias("row"))
    return cell_texts(as_of(placed, lines, [page], y, "lo", "row"), [page, "row", "col"], y, x, text)


def cell_texts(glyphs: DataFrame, by: list[str], y: str, x: str, text: str) -> DataFrame:
    """Texts of each cell in order of (rounded y, x)."""
    parts = F.array_sort(F.collect_list(F.struct(F.round(y).alias("y"), F.col(x).alias("x"), F.col(text).alias("t"))))
    return glyphs.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("cell"))
