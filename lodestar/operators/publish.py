"""Publication of results: values with a status, minimal rows, features, counts, sections, one file per key."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.columns import search_form

from .numbering import numbered

# The status vocabulary.
STATUSES = ("observed", "estimated", "suppressed", "not_available", "not_applicable", "missing_source")


def counter(df: DataFrame, key: Column) -> DataFrame:
    """key (text, "none" for null), n."""
    return df.groupBy(F.coalesce(key.cast("string"), F.lit("none")).alias("key")).agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, key: str, dimension: DataFrame) -> DataFrame:
    """key, n for every key of the dimension."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return dimension.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def filtered(df: DataFrame, text: Column, query: str | None = None, classes: tuple[str, ...] = (), class_column: str | None = None, located: Column | None = None, unicode_form: bool = True) -> DataFrame:
    """Conjunction of an optional substring in search form, optional classes (none: all) and an optional presence of coordinates."""
    if classes and class_column:
        df = df.filter(F.col(class_column).isin(*classes))
    if located is not None:
        df = df.filter(located)
    if query:
        df = df.filter(F.contains(text, search_form(F.lit(query), unicode_form)))
    return df


def features(df: DataFrame, order: str, x: str, y: str) -> DataFrame:
    """Rows with both coordinates and dense numbers from 0 in input order, with ``geometry`` as JSON."""
    there = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))
    return numbered(there, order, column="feature", start=0).withColumn("geometry", geometry)


def minimal(df: DataFrame, names: dict[str, str], empty: tuple[str, ...] = ()) -> DataFrame:
    """Short keys; columns of ``empty`` become empty text where null."""
    return df.select(*[(F.coalesce(F.col(c), F.lit("")) if c in empty else F.col(c)).alias(short) for short, c in names.items()])


def policy_status(policy: Column, has_data: Column) -> Column:
    """Status of a section by its source's policy."""
    return F.when(policy == "redistribute", F.when(has_data, "observed").otherwise("not_available")).when(policy == "link_only", "suppressed").when(policy == "not_provided", "missing_source").otherwise("not_applicable")


def estimated_section(df: DataFrame, estimate: DataFrame, key: str, value: str) -> DataFrame:
    """Left join to a report's rows: the value is estimated where there is one, else not available."""
    both = df.join(estimate.select(key, F.col(value).alias("__v")), key, "left")
    return both.withColumn("section", F.struct(F.col("__v").alias("value"), F.when(F.col("__v").isNotNull(), "estimated").otherwise("not_available").alias("status"))).drop("__v")


def neighbour_section(pairs: DataFrame, attributes: DataFrame, digits: int = 4) -> DataFrame:
    """src, neighbours: array in order of rank, with looked-up attributes."""
    cols = [c for c in attributes.columns if c != "dst"]
    one = F.struct("rank", "dst", F.round("distance", digits).alias("distance"), *cols)
    return pairs.join(attributes, "dst").groupBy("src").agg(F.array_sort(F.collect_list(one)).alias("neighbours"))


def neighbour_states(rows: DataFrame, key: str, pairs: DataFrame, attributes: DataFrame, gate: bool | None) -> DataFrame:
    """``rows`` with status and neighbours: missing_source without a report (``gate`` is null), suppressed where its gate fails, else estimated or not_available."""
    if not gate:
        kind = neighbour_section(pairs.limit(0), attributes.limit(0)).schema["neighbours"].dataType
        return rows.withColumn("status", F.lit("missing_source" if gate is None else "suppressed")).withColumn("neighbours", F.lit(None).cast(kind))
    found = neighbour_section(pairs, attributes).withColumnRenamed("src", key)
    return rows.join(found, key, "left").withColumn("status", F.when(F.col("neighbours").isNull(), "not_available").otherwise("estimated"))


def in_fixed_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """place, key, n of the groups that have rows, in a fixed order of keys; empty groups go. Keys outside of the order raise."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(key))
    n = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("at", F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown key "), F.col(key))).cast("long")))
    # At most as many rows as the order has keys.
    return n.select(F.row_number().over(Window.orderBy("at")).cast("long").alias("place"), key, "n")


def fetch_plan(listing: DataFrame, policies: DataFrame, name: str, policy: str, allowed: str) -> DataFrame:
    """Rows of the listing whose ``name`` may be fetched; a name without a policy stops the job."""
    both = listing.join(F.broadcast(policies), name, "left")
    known = F.when(F.col(policy).isNotNull(), F.col(policy)).otherwise(F.raise_error(F.concat(F.lit("no policy for "), F.col(name))))
    return both.filter(known == allowed).drop(policy)


def size_differs(files: DataFrame, said: str, found: str, share: float = 0.03) -> DataFrame:
    """Files whose size is further from what their page says than ``share`` of it."""
    return files.filter(F.abs(F.col(found) - F.col(said)) > share * F.col(said))


def to_fetch(plan: DataFrame, there: DataFrame, file: str, size: str) -> DataFrame:
    """Rows of the plan that aren't there yet with the same name and size: a file of another size is fetched again."""
    return plan.join(there.select(file, size).distinct(), [file, size], "left_anti")


def sizes_checked(files: DataFrame, said: str, found: str, share: float = 0.03) -> DataFrame:
    """The files; one whose size is further off than ``share`` stops the job."""
    off = F.abs(F.col(found) - F.col(said)) > share * F.col(said)
    return files.filter(F.when(F.coalesce(off, F.lit(False)), F.raise_error(F.concat(F.lit("size "), F.col(found).cast("string"), F.lit(" instead of "), F.col(said).cast("string")))).otherwise(True))


def forbidden(df: DataFrame, names: list[str]) -> list[str]:
    """Columns that must not be there."""
    return sorted(set(df.columns) & set(names))


def one_file_per_key(df: DataFrame, key: str, folder: str) -> DataFrame:
    """Writes each row as a JSON file named by its key (any URI that pyarrow.fs opens): key, path, bytes, to be consumed once.

    Files are written whole under their final name, so a repeated task writes the same file again.
    """
    return files_by_key(df.select(F.col(key).cast("string").alias("key"), F.encode(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), "UTF-8").alias("body")), folder, ".json")


def files_by_key(df: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Writes ``body`` (binary) of each row to a file named by ``key`` and suffix: key, path, bytes, to be consumed once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = body.as_py()
                path = f"{root}/{k}{suffix}"
                with store.open_output_stream(path, compression=None) as f:
                    f.write(data)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["key", "path", "bytes"])

    return df.select(F.col("key").cast("string"), "body").mapInArrow(write, "key string, path string, bytes long")


def document(df: DataFrame, order: list[str], folder: str, name: str) -> DataFrame:
    """Writes a small table as one JSON file, an array of its rows in order, with characters beyond ASCII as they are: key, path, bytes."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("__row")))), lambda r: r["__row"])
    return files_by_key(df.agg(F.lit(name).alias("key"), F.encode(F.to_json(rows, {"ignoreNullFields": "false"}), "UTF-8").alias("body")), folder, ".json")


def rebuilt(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` anew from ``df``, whatever was there, and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resumed(wanted: DataFrame, path: str, key: str, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Builds the parts of a partitioned table that are missing: the table, and the keys that were built now.

    ``build`` gets the missing keys and returns their rows with ``key``. Parts that are there are neither read nor written; a part counts once its
    rows are committed, so a job that failed goes on where it stopped.
    """
    spark = wanted.sparkSession
    kind = wanted.schema[key].dataType
    try:
        done = spark.read.parquet(path).select(F.col(key).cast(kind))
    except AnalysisException:  # nothing is there yet
        done = wanted.select(key).limit(0)
    keys = [r[0] for r in missing_parts(wanted, done, key).collect()]  # keys of parts, a small dimension
    if keys:
        fresh = spark.createDataFrame([(k,) for k in keys], wanted.select(key).schema)
        build(fresh).write.mode("append").partitionBy(key).parquet(path)
    return spark.read.parquet(path).withColumn(key, F.col(key).cast(kind)), spark.createDataFrame([(k,) for k in keys], wanted.select(key).schema)


def replaced(fresh: DataFrame, path: str, key: str, only: bool = False) -> DataFrame:
    """A partitioned table after the parts of ``fresh`` took the place of those that were there; other parts stay as they are.

    ``only`` marks a trial with some of the parts: it raises unless the table holds others that it would leave, so that a whole table is never made by a trial.
    """
    spark = fresh.sparkSession
    if only:
        try:
            others = spark.read.parquet(path).select(key).distinct().join(fresh.select(key).distinct(), key, "left_anti")
            safe = not others.isEmpty()
        except AnalysisException:
            safe = False
        if not safe:
            raise ValueError("a trial must not make the whole table")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return spark.read.parquet(path).withColumn(key, F.col(key).cast(fresh.schema[key].dataType))


def optional_section(df: DataFrame, product: DataFrame | None, key: str, value: str) -> DataFrame:
    """``estimated_section``, or every row with the status missing_source where the product doesn't exist."""
    if product is None:
        return df.withColumn("section", F.struct(F.lit(None).cast("double").alias("value"), F.lit("missing_source").alias("status")))
    return estimated_section(df, product, key, value)


def missing_parts(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Parts of a resumable build that are still to do."""
    return wanted.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def manifest_rows(datasets: dict[str, DataFrame | None]) -> DataFrame:
    """dataset, rows of each dataset that exists, counted in one job."""
    there = [df.select(F.lit(name).alias("dataset")) for name, df in datasets.items() if df is not None]
    names = [name for name, df in datasets.items() if df is not None]
    spark = next(df for df in datasets.values() if df is not None).sparkSession
    n = reduce(DataFrame.unionByName, there).groupBy("dataset").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in names], "dataset string").join(n, "dataset", "left").select("dataset", F.coalesce("n", F.lit(0)).cast("long").alias("rows"))


def manifest(datasets: dict[str, DataFrame | None]) -> str:
    """JSON with the row count of each dataset that exists."""
    return json.dumps({r["dataset"]: {"rows": r["rows"]} for r in manifest_rows(datasets).collect()}, ensure_ascii=False, sort_keys=True)


def union_columns(records: DataFrame, data: str, *order: str) -> list[str]:
    """The keys of all maps in ``data``, by where they come first; keys are a schema, so few."""
    at = records.select(*order, F.posexplode(F.map_keys(data)).alias("__i", "key"))
    return [r["key"] for r in at.groupBy("key").agg(F.min(F.struct(*order, "__i")).alias("f")).orderBy("f").collect()]


def csv_with_union(records: DataFrame, fixed: list[str], data: str, order: list[str], folder: str) -> list[str]:
    """Writes CSV with a byte-order mark: ``fixed`` columns, then the union of the maps' keys as they first come; the columns.

    Rows are put in order by ranges, a file for each, so a log of any length passes no single task; each file has the header.
    """
    more = union_columns(records, data, *order)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fixed] + [F.coalesce(F.try_element_at(data, F.lit(k)), F.lit("")).alias(k) for k in more]
    rows = records.repartitionByRange(*order).sortWithinPartitions(*order).select(*text)
    first = rows.columns[0]
    rows.withColumnRenamed(first, f"\ufeff{first}").write.csv(folder, header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8")
    return rows.columns
